"""Exact dedup, connected components and the Jaccard join, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, empty, near_copies, rows
from tillroll.llm.components import components
from tillroll.llm.exact_dedup import build_directory, exact_dedup
from tillroll.llm.jaccard_join import jaccard_join, min_hashes, shingles


def plain_dedup(pairs: list[tuple]) -> Counter:
    groups: dict[str, list] = {}
    for k, text in pairs:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", text or ""), []).append(k)
    out: Counter = Counter()
    for text, ids in groups.items():
        real = sorted(k for k in ids if k is not None)
        ids = real + [k for k in ids if k is None]
        digest = hashlib.sha256(text.encode()).hexdigest()
        for place, k in enumerate(ids):
            out[k, ids[0], len(ids), place == 0, digest] += 1
    return out


def found(df) -> Counter:
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_dedup_of_awkward_rows(spark):
    assert found(exact_dedup(awkward(spark))) == plain_dedup([(r[0], r[1]) for r in rows()])
    assert exact_dedup(empty(spark)).collect() == []


def test_dedup_with_colliding_keys_and_overflow_pages(spark):
    rng = random.Random(1)
    texts = [f"text {i} " + "x" * rng.randint(0, 40) for i in range(30)]
    pairs = [(i, rng.choice(texts)) for i in range(300)] + [(i, texts[0]) for i in range(300, 500)]
    pairs += [(None, texts[0]), (7, texts[1]), (7, texts[1])]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    # one key for all texts, and a few: every bucket holds chains, none can split, and pages overflow
    for key in (F.lit(0), F.length("norm") % 3):
        got = exact_dedup(df, key=key, max_depth=4, least_bucket=500, most_bucket=500)
        assert found(got) == plain_dedup(pairs)


def test_directory_splits_overfull_buckets_only():
    sizes = np.zeros(16, dtype=np.int64)
    sizes[[0, 1, 2, 15]] = 60, 60, 10, 250
    directory = build_directory(sizes, 4, 100)
    assert [slot for slot, _, _ in directory] == list(range(16))
    buckets = {bucket: pages for _, bucket, pages in directory}
    assert buckets[15] == 3  # copies of one key: pages, as no bit parts them
    held = Counter()
    for slot, bucket, _ in directory:
        held[bucket] += int(sizes[slot])
    assert all(n <= 100 for bucket, n in held.items() if bucket != 15)
    assert build_directory(np.zeros(16, dtype=np.int64), 4, 100) == [(s, 0, 1) for s in range(16)]


def roots(edges: list[tuple[int, int]]) -> dict[int, int]:
    up = {k: k for e in edges for k in e}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {k: root(k) for k in up}


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(200, 200 + i) for i in range(1, 60)]
    edges = chain + star + [(500, 500), (1, 2), (2, 1), (1, 2)] + [(rng.randint(600, 700), rng.randint(600, 700))
                                                                   for _ in range(60)]
    rng.shuffle(edges)
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in got} == roots(edges) and len(got) == len(roots(edges))
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def plain_join(pairs: list[tuple]) -> dict:
    sets = []
    for _, text in pairs:
        w = (text or "").lower().split()
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    links, edges = [set() for _ in sets], [(i, i) for i in range(len(sets))]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 10 * len(a & b) >= 8 * len(a | b):
                links[i].add(j)
                links[j].add(i)
                edges.append((i, j))
    root = roots(edges)
    members: dict[int, list] = {}
    for i in range(len(sets)):
        members.setdefault(root[i], []).append(i)
    out: Counter = Counter()
    for i, (k, _) in enumerate(pairs):
        own = members[root[i]]
        ids = [pairs[m][0] for m in own if pairs[m][0] is not None]
        texts = len({sets[j] for j in links[i]} - {sets[i]})
        out[k, min(ids, default=None), len(links[i]), texts, len(own)] += 1
    return out


def test_join_matches_brute_force(spark):
    base = near_copies()
    pairs = base + [(k + 1000, t) for k, t in base[:5]] + [(1, base[0][1]), (None, base[1][1]), (None, None), (3, "  ")]
    pairs += [(r[0], r[1]) for r in rows()]
    df = spark.createDataFrame([(*p, True) for p in pairs], "doc_id long, text string, kept boolean")
    got = jaccard_join(df.withColumn("n_links", F.lit(-1))).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_text_links, r.class_size) for r in got) == plain_join(pairs)
    assert sum(r.kept for r in got) == sum(1 / r.class_size for r in got).__round__()
    assert jaccard_join(empty(spark)).collect() == []


def test_join_of_a_group_larger_than_a_block(spark):
    rng = random.Random(5)
    base = [f"v{rng.randrange(3000)}" for _ in range(60)]
    pairs = []
    for i in range(600):
        words = list(base)
        words[rng.randrange(60)] = f"edit{i}"
        pairs.append((i, " ".join(words)))
    got = jaccard_join(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_text_links, r.class_size) for r in got) == plain_join(pairs)


def test_join_misses_no_pair_at_the_threshold(spark):
    pairs = []
    for g in range(2500):  # 45 shingles each, of which 40 are shared: 40 of 50 is the threshold
        words = [f"g{g}w{k}" for k in range(54)]
        pairs += [(2 * g, " ".join(words[:49])), (2 * g + 1, " ".join(words[5:]))]
    got = jaccard_join(spark.createDataFrame(pairs, "doc_id long, text string").repartition(8)).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == Counter((k, k - k % 2, 1) for k, _ in pairs)


def test_query_counts_every_link(spark, tmp_path):
    from tillroll.llm.queries import op8_jaccard_join
    pairs = near_copies(7)
    spark.createDataFrame(pairs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op8_jaccard_join(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_text_links, r.class_size) for r in got) == plain_join(pairs)


def test_buckets_over_batches_and_the_leaf():
    """Buckets that go on in later batches, larger ones than the leaf, and rows that come twice."""
    import pyarrow as pa
    from tillroll.llm.jaccard_join import _met
    rng = random.Random(9)
    sizes = [1, 2, 3, 1, 4, 9, 5, 1, 30, 2, 1, 4]
    rows_ = sorted((value, rec, (40 << 32) + 3) for value, n in enumerate(sizes) for rec in rng.sample(range(100), n))
    rows_ = [r for r in rows_ for _ in range(1 + (r[1] % 7 == 0))]
    want = set()
    for value, n in enumerate(sizes):
        own = sorted({r[1] for r in rows_ if r[0] == value})
        want |= {(own[0], v, True) for v in own[1:]} if n > 4 else {(u, v, False) for u in own for v in own if u < v}
    for step in (1, 2, 3, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows_[k:k + step])], ["value", "rec", "at"])
                   for k in range(0, len(rows_), step)]
        got = [tuple(r.values()) for b in _met(0.8, 4)(iter(batches)) for r in b.to_pylist()]
        assert set(got) == want


def test_parities_differ_in_no_more_than_the_sets():
    from tillroll.llm.jaccard_join import differing, parities
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (40, 45), (500, 600), (1000, 1030), (3000, 5000), (9000, 8000), (30, 5000)):
        own = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        other = np.unique(np.concatenate([own[n // 10:], rng.integers(0, 1 << 63, m, dtype=np.uint64)])[:m])
        apart = len(np.setxor1d(own, other))
        assert differing(parities(own), parities(other)) == differing(parities(other), parities(own)) <= apart
        assert differing(parities(own), parities(own)) == 0
        new = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))  # unlike ones are told apart, long ones too
        assert n < 40 or differing(parities(own), parities(new)) > 2 * n / 9


def test_min_hashes_estimate_similarity():
    words = [f"t{i}" for i in range(400)]
    a, b = shingles(" ".join(words)), shingles(" ".join(words[40:]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((min_hashes(a) == min_hashes(b)).mean() - true) < 0.2
    assert len(shingles("")) == 0 and len(shingles("a b")) == 1 and len(shingles("a b c d e f")) == 2


def test_join_of_long_texts_that_differ_in_their_last_word(spark):
    rng = random.Random(11)
    pairs = []
    for g in range(8):  # more than a searched bucket holds; nearly all min-hash values of a group agree
        base = " ".join(f"u{rng.randrange(100_000)}" for _ in range(1500))
        pairs += [(1000 * g + i, f"{base} end{i}") for i in range(140)]
    got = jaccard_join(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
    assert Counter((r.class_id, r.class_size, r.n_links) for r in got) == {(1000 * g, 140, 139): 140 for g in range(8)}


def by_leaders(spark, pairs):
    return jaccard_join(spark.createDataFrame(pairs, "doc_id long, text string"), count_links=False).collect()


def check_leaders(got, pairs):
    """Classes as brute force has them; every row's representative is in its class and as similar as it says."""
    plain = plain_join(pairs)
    want = Counter()
    for (k, c, _, _, n), times in plain.items():
        want[k, c, n] += times
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    assert sum(r.kept for r in got) == round(sum(1 / r.class_size for r in got))
    texts, classes = dict(pairs), {r.doc_id: r.class_id for r in got}
    for r in got:
        a, b = shingles(texts[r.doc_id] or ""), shingles(texts[r.representative_id] or "")
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b)) if len(a) else 1.0
        assert abs(r.similarity - true) < 1e-9 and r.similarity >= 0.8 and classes[r.representative_id] == r.class_id


def test_leaders_match_brute_force(spark):
    pairs = near_copies(largest=30)
    check_leaders(by_leaders(spark, pairs), pairs)
    got = jaccard_join(awkward(spark), count_links=False).collect()
    assert len(got) == len(rows()) and jaccard_join(empty(spark), count_links=False).collect() == []


def test_leaders_of_groups_larger_than_a_block(spark, monkeypatch):
    """Tight groups, and a chain of small changes whose ends differ wholly: links cross the followers of many leaders."""
    from tillroll.llm import jaccard_join as module
    monkeypatch.setattr(module, "BLOCK", 12)
    monkeypatch.setattr(module, "LEAF", 12)
    rng = random.Random(3)
    texts = []
    for g in range(2):
        base = [f"g{g}v{rng.randrange(3000)}" for _ in range(80)]
        for i in range(90):
            words = list(base)
            words[rng.randrange(80)] = f"edit{i}"
            texts.append(" ".join(words))
    words = [f"c{i}" for i in range(120)]
    for i in range(100):
        words[i] = f"d{i}"
        if i % 2:
            texts.append(" ".join(words))
    rng.shuffle(texts)
    pairs = list(enumerate(texts))
    check_leaders(by_leaders(spark, pairs), pairs)


def test_leaders_make_rows_in_proportion(spark):
    """One piece of work for each row of a large group, not one for each block of it."""
    from tillroll.llm.jaccard_join import BLOCK, _in_blocks
    rows_ = spark.range(40 * BLOCK).select(F.col("id").alias("rec"), F.lit(1).alias("root"), F.lit(40 * BLOCK).alias("size"))
    dealt = _in_blocks(rows_, "root", "size", stuck=F.lit(False))
    assert dealt.count() == 40 * BLOCK and dealt.where("not lead or side <> 0").count() == 0
    assert _in_blocks(rows_.limit(2 * BLOCK).withColumn("size", F.lit(2 * BLOCK)), "root", "size").count() == 4 * BLOCK


def test_late_links_between_parts_of_leaders(spark, monkeypatch):
    """Groups around texts that are too far from each other to be linked; some have a text between them."""
    from tillroll.llm import jaccard_join as module

    texts = []
    words = [f"w{k}" for k in range(60)]
    for step in range(12):
        words[(step * 14) % 60] = f"s{step}"
        if step % 3:
            texts.append(" ".join(words))  # one word from the text before and from the next
        words[(step * 14 + 7) % 60] = f"t{step}"
        texts += [" ".join([*words[:k], f"c{step}", *words[k + 1:]]) for k in range(5, 55, 4)] + [" ".join(words)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(module, "BLOCK", 16)
    calls = []
    between = module._between
    monkeypatch.setattr(module, "_between", lambda *a: calls.append(1) or between(*a))
    got = {r.doc_id: r.class_id for r in module.jaccard_join(df, count_links=False).collect()}
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)})
    root = list(range(len(sets)))
    for i, a in enumerate(sets):  # classes by brute force
        for j in range(i):
            if 10 * len(a & sets[j]) >= 8 * len(a | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert got == dict(enumerate(root))
    assert calls
