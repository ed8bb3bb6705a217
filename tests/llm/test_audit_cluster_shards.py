"""Filter audit, centroid clustering and Hilbert sharding against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import helpers
from tillroll.llm.clustering import cluster_vectors, nearest
from tillroll.llm.filter_audit import COUNTS, audit_counts, filter_audit, removal_intervals
from tillroll.llm.hilbert_shards import hilbert_index, shard_ranges, shards_of, write_shards

SF01 = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int, text string"


# ---- filter audit ------------------------------------------------------------

def audited(rows, labels):
    """(part, order, step) -> counts, one document and one order after the other."""
    first, marks = {}, defaultdict(lambda: [0, 0])
    for doc_id, text, part in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    for doc_id, quality, toxic in labels:
        if doc_id is not None:
            marks[doc_id][0] |= quality == 1
            marks[doc_id][1] |= toxic == 1
    found = {}
    for doc_id, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {f for f, bad in {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and first[text] < doc_id}.items() if bad}
        good, toxic = marks[doc_id] if doc_id is not None else (0, 0)
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                own = found.setdefault((part or "", order, step), dict.fromkeys(COUNTS, 0))
                now = not gone and f in fails
                own["removed"] += now
                own["good_lost"] += now and good
                own["toxic_lost"] += now and toxic
                own["redundant"] += gone and f in fails
                own["unique_fails"] += fails == {f}
                gone = gone or now
                own["kept"] += not gone
    total = Counter()
    for (part, order, step), own in found.items():
        total[part, order[step - 1]] += own["removed"]
    for (part, order, step), own in found.items():
        own["shapley"] = total[part, order[step - 1]]
    return found


def as_found(df):
    return {(r["part"], r["filter_order"], r["step"]): {c: r[c] for c in COUNTS} for r in df.collect()}


def test_removal_intervals_cover_every_order_once():
    orders = list(permutations(range(5)))
    for mask in range(32):
        steps = {}
        for step, first, end in removal_intervals(mask):
            for rank in range(first, end):
                assert rank not in steps
                steps[rank] = step
        for rank, order in enumerate(orders):
            met = [s for s, f in enumerate(order) if mask >> f & 1]
            assert steps.get(rank) == (met[0] if met else None)


def test_audit_counts_of_no_documents():
    assert all((v == 0).all() for v in audit_counts(np.array([3]), np.zeros((1, 3), dtype=np.int64)).values())


def test_audit_equals_brute_force_on_awkward_rows(spark):
    rng = random.Random(4)
    words = ["apple", "Bee", "c|d", "EEL", "fig", "#", "gnu", "ÄÖ", "😀"]
    rows = [(r[0], r[1], r[3]) for r in helpers.rows()]
    rows += [(rng.choice([*range(100, 160), None]), " ".join(rng.choices(words[:rng.randint(1, 9)] + [f"w{k}" for k in range(rng.choice([0, 80]))], k=rng.choice([0, 3, 49, 50, 120]))),
              rng.choice(["x", "", None, "src0"])) for _ in range(150)]
    rows += [(k, "the same text", "x") for k in range(500, 540)] * 2
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in [*range(1, 160), *range(100, 120), 505, None]]
    docs = spark.createDataFrame([(a, b, c, 1, "e") for a, b, c in rows],
                                 "doc_id long, text string, source string, mask int, part string")
    got = filter_audit(docs, spark.createDataFrame([(*r, "x") for r in labels], LABELS))
    assert as_found(got) == audited(rows, labels)


def test_audit_of_empty_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit(helpers.empty(spark), labels).count() == 0
    assert filter_audit(helpers.awkward(spark), labels).where("good_lost + toxic_lost > 0").count() == 0


# ---- clustering --------------------------------------------------------------

@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_nearest_equals_brute_force(spread):
    rng = np.random.default_rng(spread)
    centroids = rng.integers(-spread, spread + 1, (16, 5))
    centroids[7] = centroids[2]  # a tie everywhere
    vectors = np.concatenate([rng.integers(-spread, spread + 1, (500, 5)), centroids])
    away = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    where, distance, taken = nearest(vectors, centroids)
    assert (where == away.argmin(axis=1)).all() and (distance == away.min(axis=1)).all()
    assert spread < 1000 or taken.mean() < 16  # the bound ends walks early


def clustered(rows, clusters=16, rounds=3):
    """vec_id -> what the query returns, of (id, list of floats)."""
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest()))
    centroids = [list(v) for _, v in start[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for k in range(len(centroids)):
            of = [v for (_, v), (_, c) in zip(kept, own) if c == k]
            if of:
                centroids[k] = [sum(column) // len(of) for column in zip(*of)]
    own = assign()
    inertia = Counter()
    for d, k in own:
        inertia[k] += d
    return sorted((str(i), k, d, inertia[k], sum(inertia.values()),
                   hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest())
                  for (i, _), (d, k) in zip(kept, own))


def test_clustering_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=64).astype("float32").tolist()) for k in range(60)]
    rows += [(100, None), (101, []), (102, [0.5] * 63), (103, [0.5] * 65), (104, [0.5] * 63 + [None]),
             (105, [0.5] * 63 + [float("nan")]), (106, [0.5] * 63 + [float("-inf")]), (None, [0.25] * 64),
             (107, [-0.001] * 64), (107, [-0.001] * 64), (108, rows[3][1]), (109, rows[3][1])]
    df = spark.createDataFrame([(a, b, 1, 2.0) for a, b in rows],
                               "vec_id long, embedding array<float>, cluster int, id double")
    got = sorted((str(r[0]), *r[1:]) for r in cluster_vectors(df).collect())
    assert got == clustered(rows)
    few = df.where("vec_id < 3")
    got = sorted((str(r[0]), *r[1:]) for r in cluster_vectors(few).collect())
    assert got == clustered([r for r in rows if r[0] is not None and r[0] < 3])
    assert cluster_vectors(df.where("vec_id >= 100 and vec_id < 107")).count() == 0


# ---- Hilbert sharding --------------------------------------------------------

def test_hilbert_index_walks_to_neighbours(spark):
    for bits, n in ((1, 2), (3, 2), (2, 3), (2, 4)):
        points = list(product(range(1 << bits), repeat=n))
        df = spark.createDataFrame(points, ", ".join(f"a{i} int" for i in range(n)))
        got = hilbert_index([F.col(f"a{i}") for i in range(n)], bits, df).orderBy("curve").collect()
        assert [r["curve"] for r in got] == list(range(len(points)))
        for a, b in zip(got, got[1:]):
            assert sum(abs(x - y) for x, y in zip(a[:n], b[:n])) == 1


def checked(got, docs, shards=24):
    """The law of the shards, and one row for each document."""
    rows = got.collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()))
                   for r in docs.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    sizes = [len(slots[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sorted(sizes, reverse=True) == sizes and set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sorted((r["shard"], r["slot"], r["doc_id"] is None, r["doc_id"] or 0, r["text_crc32"]) for r in rows)


def test_shards_of_awkward_rows(spark):
    docs = helpers.awkward(spark).withColumn("shard", F.lit("clash")).withColumn("slot", F.lit(None).cast("string"))
    first = checked(shards_of(docs), docs)
    # the same rows otherwise partitioned; every piece a row or two
    assert checked(shards_of(docs.repartition(7)), docs) == first
    assert checked(shards_of(docs, least_piece=1), docs)
    few = docs.where("doc_id between 3 and 5")
    checked(shards_of(few), few)
    assert shards_of(docs.limit(0)).count() == 0


def test_shard_files_hold_the_rows_as_they_were(spark, tmp_path):
    docs = helpers.awkward(spark).withColumn("shard", F.lit("clash"))
    files = write_shards(docs, str(tmp_path / "shards"))
    assert files.columns == [*docs.columns[:-1], "shard_", "shard", "slot"]
    own = files.select(*docs.columns[:-1], F.col("shard_").alias("shard"))
    assert own.exceptAll(docs).count() == 0 and docs.exceptAll(own).count() == 0


def test_many_equal_rows_are_numbered_from_one(spark):
    """A third of the rows are equal in every column."""
    hot = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"),
                                   F.lit("en").alias("lang"), F.lit("src").alias("source"))
    rest = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"),
                                    F.lit("en").alias("lang"), F.lit("src").alias("source"))
    docs = hot.unionByName(rest)
    checked(shards_of(docs, least_piece=200), docs)


def test_shards_are_narrow_in_several_dimensions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    files = write_shards(docs, str(tmp_path / "shards")).withColumn("size", F.octet_length("text"))
    got = shard_ranges(files.where("text is not null"), ["doc_id", "size"]).collect()
    span = docs.agg(F.max("doc_id") - F.min("doc_id")).first()[0]
    # a query for a tenth of the ids in the lower half of the sizes reads about half of the shards at most
    middle = files.approxQuantile("size", [0.5], 0.0)[0]
    hit = [r for r in got if r["least_doc_id"] <= span / 10 and r["least_size"] <= middle / 2]
    assert len(got) == 24 and len(hit) <= 14
