"""The pipeline's stages on a small table, against the operators and brute force."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, awkward, near_copies

SF001 = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_compose(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "exact_dedup", "jaccard_join", "packing"]
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF001).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= left
            left = docs.count()
    assert docs.select("doc_id").distinct().count() == left
    again = corpus_pipeline.run(spark, SF001)
    assert sorted(map(tuple, again.select("doc_id", "piece", "ids_crc32").collect())) == sorted(
        map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()))


def test_duplicate_stages_keep_one_of_each(spark, tmp_path):
    pairs = near_copies(1, groups=5, largest=6)
    rows = [(k, t, "en", "s", len(t), None, None, None) for k, t in pairs]
    rows += [rows[0], (9000, rows[0][1], None, None, None, True, 1.0, "x"), (None, rows[1][1], *[None] * 6), (9001, None, *[None] * 6)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    docs = spark.read.parquet(path)
    unique = corpus_pipeline.exact(spark, docs, SF001)
    wanted = {}
    for row in rows:
        text = " ".join((row[1] or "").split())
        wanted[text] = min(wanted.get(text, 10**9), 10**9 if row[0] is None else row[0])
    assert unique.columns == docs.columns
    assert sorted(r.doc_id for r in unique.collect()) == sorted(wanted.values())
    unique.write.parquet(str(tmp_path / "unique"))
    left = corpus_pipeline.near(spark, spark.read.parquet(str(tmp_path / "unique")), SF001)
    sets = []
    for r in left.where(F.col("text") != "").collect():
        w = r.text.lower().split()
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))))
    assert all(10 * len(a & b) < 8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    for stage in (corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.quality, corpus_pipeline.toxicity):
        assert stage(spark, docs.limit(0), SF001).collect() == []


def test_stages_on_awkward_rows(spark, tmp_path):
    awkward(spark).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    whole = sorted(map(str, docs.collect()))
    for stage in (corpus_pipeline.quality, corpus_pipeline.toxicity, corpus_pipeline.exact, corpus_pipeline.near):
        left = stage(spark, docs, SF001)
        assert left.columns == docs.columns
        got = sorted(map(str, left.collect()))
        assert got and set(got) <= set(whole) and len(got) <= len(whole), stage.__name__
        if stage in (corpus_pipeline.quality, corpus_pipeline.toxicity):
            # rows with one id and text have one decision
            assert all(got.count(row) in (0, whole.count(row)) for row in whole)
    # exact dedup: of empty and null texts one stays, white space alone is another text
    unique = corpus_pipeline.exact(spark, docs, SF001).collect()
    assert [r.doc_id for r in unique if not (r.text or "").strip()] == [3, 5]
    packed = corpus_pipeline.packing(spark, docs, SF001)
    pieces = packed.collect()
    assert sum(r.piece == 0 for r in pieces) == len(whole)  # every row, repeated ones and those without an id
    assert all(r.length == 1 for r in pieces if r.doc_id in (3, 4))
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by_sequence.values():
        placed.sort()
        assert [o for o, _ in placed] == [sum(n for _, n in placed[:k]) for k in range(len(placed))]
        assert sum(n for _, n in placed) <= 4096
    assert corpus_pipeline.packing(spark, docs.limit(0), SF001).collect() == []
