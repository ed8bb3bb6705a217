"""The scores of quality resampling and toxicity against plain loops over the same fitted numbers."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward
from tillroll.llm import quality, toxicity

SF = "/root/testdata/sf0.001"


def both(spark, label):
    """Documents of the smallest tables and awkward ones, as (frame, {id: text}, {id: label})."""
    own = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), label)
    odd = awkward(spark).select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"])
    docs = own.unionByName(odd.withColumn("doc_id", F.col("doc_id").cast(own.schema["doc_id"].dataType)))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    return docs, labels, texts, {r.doc_id: r[label] for r in labels.collect() if r.doc_id in texts}


def plain_buckets(text):
    mask, out, codes = (1 << 64) - 1, [], []
    for token in quality.TOKENS.findall(text.lower()):
        codes.append(zlib.crc32(token.encode("utf-8", "replace")))
    # a token that repeats the one before it is written as a mark of its own
    codes = [quality.AGAIN if k and c == codes[k - 1] else c for k, c in enumerate(codes)]
    pairs = [(a * 0x9E3779B97F4A7C15 + b) & mask for a, b in zip(codes, codes[1:])]
    for code in codes + pairs:
        out.append((code * 0xD1B54A32D192ED03 & mask) * quality.BUCKETS >> 64)
    return out


def test_resampling_matches_plain_counts(spark):
    docs, labels, texts, label = both(spark, "quality")
    used = {k: Counter(plain_buckets(t)) for k, t in texts.items()}
    raw, target = Counter(), Counter()
    for k, counts in used.items():
        raw.update(counts)
        if label.get(k) == 1:
            target.update(counts)
    assert sum(target.values()) > 1000
    whole = sum(raw.values()) + quality.BUCKETS
    good = sum(target.values())
    extra = max(1.0, good / 10)

    def ratio(bucket):
        p = (raw[bucket] + 1) / whole
        return math.log((target[bucket] + extra * p) / (good + extra) / p)

    got = quality.resample(docs, labels, k=60).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.n_ngrams == sum(used[r.doc_id].values())
        assert r.log_weight == pytest.approx(sum(n * ratio(b) for b, n in used[r.doc_id].items()), rel=1e-9, abs=1e-7)
    # Gumbel top-k: those with the largest keys, ties of the rounded key together
    place = {r.doc_id: math.floor(r.key * quality.KEY_UNITS) for r in got}
    least = sorted(place.values(), reverse=True)[59]
    assert {r.doc_id for r in got if r.kept} == {k for k, v in place.items() if v >= least}


def test_toxicity_matches_plain_scores(spark):
    docs, labels, texts, label = both(spark, "toxic")
    sample = sorted((y, texts[k]) for k, y in label.items() if y in (0, 1))
    assert {y for y, _ in sample} == {0, 1}
    numbers, slope, offset = toxicity.train([t for _, t in sample], [y for y, _ in sample])

    def number(word):
        marked = f"<{word}>"
        grams = [marked[i:i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
        return sum(numbers[zlib.crc32(g.encode("utf-8", "replace")) % toxicity.BUCKETS] for g in grams) / len(grams)

    for r in toxicity.score_toxicity(docs, labels).collect():
        values = []
        for word in toxicity.WORDS.findall(texts[r.doc_id].lower()):
            value = number(word)
            if not values or value != values[-1]:
                values.append(value)
        runs = [values[i:i + toxicity.WINDOW] for i in range(max(1, len(values) - toxicity.WINDOW + 1))]
        worst = max(sum(x) / len(x) if x else 0.0 for x in runs)
        odds = max(-500.0, min(500.0, slope * worst + offset))
        assert r.score == pytest.approx(1 / (1 + math.exp(-odds)), rel=1e-6, abs=1e-12)
        assert r.predicted == (1 if r.score >= 0.5 else 0)
