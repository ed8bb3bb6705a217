"""Toxicity, quality resampling and language identification."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, empty, rows
from tillroll.llm.common import held_out
from tillroll.llm.language_id import fit, identify_languages, word_scores, _scaled_trie
from tillroll.llm.quality import best_cut, kth_largest, log_ratio, resample
from tillroll.llm.toxicity import ngrams, passage_means, runs_once, score_toxicity, train, words_of

SF01 = "/root/testdata/sf0.01"


def tables(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    return docs, labels


def test_forward_sums_all_segmentations():
    model = {"▁": [0.2, 0.1], "▁a": [0.1, 0.3], "a": [0.3, 0.2], "ab": [0.2, 0.1], "b": [0.1, 0.2], "▁ab": [0.05, 0.1]}

    def total(text: str, k: int) -> float:
        return 1.0 if not text else sum(model[text[:n]][k] * total(text[n:], k)
                                        for n in range(1, len(text) + 1) if text[:n] in model)

    trie = _scaled_trie(model)
    for word in ("a", "ab", "abab", "baab", "ab" * 60):
        got = word_scores(trie, word, 2)
        if len(word) < 10:
            assert np.allclose(got, [math.log(total("▁" + word, k)) for k in (0, 1)])
        assert all(math.isfinite(x) for x in got)
    # a rescaled long word scores as the product of its parts would, up to its joints
    assert abs(word_scores(trie, "ab" * 200, 2)[0] / word_scores(trie, "ab" * 100, 2)[0] - 2) < 0.1


def test_language_fit_is_a_distribution():
    from collections import Counter
    model = fit([Counter(["ab", "ab", "b"]), Counter(["ba"])], {"▁": -1, "a": -2, "b": -3, "ab": -4, "▁ab": -5})
    for k in (0, 1):
        assert abs(sum(p[k] for p in model.values()) - 1) < 1e-9
    assert model["▁ab"][0] > model["▁ab"][1]


def test_languages_of_held_out_texts(spark):
    docs, _ = tables(spark)
    got = identify_languages(docs, docs.where(~held_out("doc_id")).select("doc_id", "lang"), sample_rows=60)
    right = got.join(docs.where(held_out("doc_id")).select("doc_id", "lang"), "doc_id").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_languages_of_awkward_rows(spark):
    df = awkward(spark)
    got = identify_languages(df, df.select("doc_id", "lang")).collect()
    assert len(got) == len(rows())
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (3, 4, 5, 11))
    assert all(r.lang_pred in ("de", "en", "fr") and 0 <= r.score <= 1 for r in got if r.doc_id in (6, 8, 10, 12))
    nothing = identify_languages(df, df.select("doc_id", F.lit(None).cast("string").alias("lang"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert identify_languages(empty(spark), empty(spark).select("doc_id", "lang")).collect() == []


def test_toxicity_of_unseen_misspellings():
    rng = random.Random(0)
    clean = [f"c{rng.randrange(300)}ab" for _ in range(300)]
    bad = ["horrible", "awfully", "nastiest"]

    def text(toxic: bool) -> str:
        words = rng.choices(clean, k=rng.randint(20, 60))
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        return " ".join(words)

    labels = [i % 2 for i in range(200)]
    per_bucket, slope, offset = train([text(bool(y)) for y in labels], labels)

    def score(t: str) -> float:
        own = np.array([per_bucket[ngrams(w)].mean() for w in words_of(t)])
        return slope * passage_means(runs_once(own)).max() + offset

    harmless = sorted(score(text(False)) for _ in range(50))
    assert sum(x < 0 for x in harmless) >= 48
    # what the misspelling shares with known words lifts the text above harmless ones
    unseen = [score(" ".join(rng.choices(clean, k=40)) + " " + w)
              for w in ("horrrible", "horribly", "awfuly", "nastyest", "nastiest!")]
    assert min(unseen) > harmless[45] and sum(x > 0 for x in unseen) >= 3


def test_toxicity_of_held_out_texts(spark):
    docs, labels = tables(spark)
    got = score_toxicity(docs, labels.where(~held_out("doc_id"))).join(labels.where(held_out("doc_id")), "doc_id").collect()
    right = [(r.predicted == r.toxic, r.toxic) for r in got]
    assert np.mean([ok for ok, y in right if not y]) > 0.85 and np.mean([ok for ok, y in right if y]) > 0.5


def test_toxicity_of_awkward_rows(spark):
    df = awkward(spark).withColumn("predicted", F.lit(9))
    labels = df.select("doc_id", F.when(F.col("doc_id") < 3, F.col("doc_id") - 1).alias("toxic"))
    got = score_toxicity(df, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    one_kind = score_toxicity(df, df.select("doc_id", F.lit(0).alias("toxic"))).collect()
    assert {r.predicted for r in one_kind} == {0}
    assert score_toxicity(empty(spark), empty(spark).select("doc_id", F.lit(1).alias("toxic"))).collect() == []


def test_kth_largest(spark):
    rng = random.Random(3)
    values = [rng.randint(-10**14, 10**14) for _ in range(500)] + [7] * 40 + [-10**15, 10**15]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for k in (1, 2, 270, 541, 542):
        assert kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(df, "x", 543) is None and kth_largest(df, "x", 0) is None
    assert kth_largest(df.limit(0), "x", 1) is None


def test_cut_and_ratio():
    assert 2 < best_cut(np.array([5.0, 1, 2, 6]), np.array([True, False, False, True])) < 5
    assert best_cut(np.zeros(0), np.zeros(0, dtype=bool)) == -np.inf
    ratio = log_ratio(np.array([9.0, 0]), np.array([9.0, 9]))
    assert ratio[0] > 0 > ratio[1]


def test_resampling_keeps_good_texts(spark):
    docs, labels = tables(spark)
    got = resample(docs, labels.where(~held_out("doc_id"))).join(labels.where(held_out("doc_id")), "doc_id").collect()
    assert np.mean([r.kept for r in got if r.quality]) > 0.95 and np.mean([not r.kept for r in got if not r.quality]) > 0.9
    few = resample(docs, labels, k=100)
    kept = few.where("kept")
    assert kept.count() == 100
    assert kept.agg(F.min("key")).first()[0] >= few.where("not kept").agg(F.max("key")).first()[0]


def test_resampling_of_equal_weights_is_even(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    labels = df.where("doc_id < 10").select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    kept = [r.doc_id for r in resample(df, labels, k=1000).where("kept").collect()]
    assert len(kept) == 1000 and abs(np.mean(kept) - 2000) < 120


def test_resampling_of_awkward_rows(spark):
    df = awkward(spark)
    labels = df.select("doc_id", F.when(F.col("doc_id") < 3, F.col("doc_id") - 1).alias("quality"))
    got = resample(df, labels).collect()
    assert len(got) == len(rows()) and all(r.log_weight == 0 and r.n_ngrams == 0 for r in got if r.doc_id in (3, 4, 5))
    assert all(r.kept for r in resample(df, df.select("doc_id", F.lit(1).alias("quality"))).collect())
    assert not any(r.kept for r in resample(df, labels, k=0).collect())
    assert resample(empty(spark), empty(spark).select("doc_id", F.lit(1).alias("quality"))).collect() == []


def test_sample_is_drawn_among_the_rows_that_are_left(spark):
    from tillroll.llm.common import labelled_sample
    labels = spark.createDataFrame([(k, k % 2 == 0) for k in range(4000)], "doc_id long, toxic boolean")
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(4000) if k % 2 or k < 100], "doc_id long, text string")
    sample = labelled_sample(docs, labels, "doc_id", "text", "toxic", 60)
    assert sum(label for label, _ in sample) >= 50  # all 50, as there are fewer than 60 left


def test_language_words_are_letters_only(spark):
    from tillroll.llm.language_id import words_of
    assert words_of("² ½ Ⅷ ٣ 42 _") == [] and words_of("x² Straße½ok") == ["x", "straße", "ok"]
    docs = spark.createDataFrame([(1, "² ½"), (2, "Ⅷ"), (3, "the house"), (4, "das Haus")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, "en"), (4, "de")], "doc_id long, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(docs, labels).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] == "en" and got[4][0] == "de"
    none = identify_languages(docs.limit(0), labels)
    assert none.count() == 0
    assert {r.lang_pred for r in identify_languages(docs.where("doc_id < 3"), labels).collect()} == {"und"}


def test_language_fit_learns_from_long_words():
    """Words of any length add what their parts add, as the plain sums in logarithms say."""
    import math
    from collections import Counter

    from tillroll.llm import language_id as module
    pieces = {"▁": -1 << 20, "a": -2 << 20, "b": -3 << 20, "ab": -4 << 20, "ba▁": -5 << 20}
    for word in ("ab" * 100, "a" * 47 + "b" * 90, "abba" * 50 + "c" + "b" * 33):
        words = [Counter({word: 2}), Counter({"ab": 1})]
        got = module.fit(words, pieces, rounds=1)
        start = {p: math.exp(s / (1 << 20)) for p, s in pieces.items()}
        total = sum(start.values())
        prob = {p: x / total for p, x in start.items()}
        marked = "▁" + word
        n = len(marked)

        def plus(values):
            top = max(values, default=-math.inf)
            return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))

        def step(i, j):
            p = prob.get(marked[i:j])
            return math.log(p) if p else (math.log(module.UNKNOWN) if j == i + 1 else -math.inf)

        ahead, back = [0.0] + [0.0] * n, [0.0] * n + [0.0]
        for j in range(1, n + 1):
            ahead[j] = plus([ahead[i] + step(i, j) for i in range(max(0, j - 3), j)])
        for i in range(n - 1, -1, -1):
            back[i] = plus([back[j] + step(i, j) for j in range(i + 1, min(n, i + 3) + 1)])
        uses = {p: module.SMOOTHING * len(pieces) * prob[p] for p in pieces}
        for i in range(n):
            for j in range(i + 1, min(n, i + 3) + 1):
                if marked[i:j] in prob:
                    uses[marked[i:j]] += 2 * math.exp(ahead[i] + step(i, j) + back[j] - ahead[n])
        for p in pieces:
            assert got[p][0] == pytest.approx(uses[p] / sum(uses.values()), rel=1e-9)
