"""Registered queries of the operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.clustering import cluster_vectors
from tillroll.llm.common import held_out, materialize, table
from tillroll.llm.exact_dedup import exact_dedup
from tillroll.llm.filter_audit import filter_audit
from tillroll.llm.hilbert_shards import shards_of
from tillroll.llm.html_template import extract_main_text
from tillroll.llm.jaccard_join import jaccard_join
from tillroll.llm.language_id import identify_languages
from tillroll.llm.merge_codec import decode_documents, encode_documents
from tillroll.llm.packing import best_fit_packing
from tillroll.llm.token_counts import token_counts
from tillroll.llm.quality import resample
from tillroll.llm.topk import exact_top_k
from tillroll.llm.toxicity import score_toxicity


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def learned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, quality and toxic of the rows that may be learned from."""
    return table(spark, sf_dir, "labels").where(~held_out("doc_id")).select("doc_id", "quality", "toxic")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, learned_labels(spark, sf_dir))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract_main_text(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), learned_labels(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, docs.where(~held_out("doc_id")).select("doc_id", "lang"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op9_merge_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of ids, a hash of the ids, and the length and SHA-256 of the text decoded from them."""
    coded = materialize(encode_documents(table(spark, sf_dir, "documents"), seed=20240501, dropout=0.1), "codec_ids")
    texts = decode_documents(coded.withColumn("digest", F.struct("doc_id", F.size("ids").cast("bigint").alias("n_ids"),
                                                                 F.xxhash64("ids").alias("ids_xxhash64"))), "digest")
    return texts.select("digest.*", F.length("text").cast("bigint").alias("n_chars"),
                        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards_of(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_toxicity": op3_toxicity,
    "op4_main_text": op4_main_text,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_importance_resampling": op6_importance_resampling,
    "op7_language_id": op7_language_id,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_merge_codec": op9_merge_codec,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_hilbert_shards": op12_hilbert_shards,
    "op13_filter_audit": op13_filter_audit,
}


def _clustering_sql(rounds: int) -> str:
    """Whole distances to all centroids in every round; the sums as joins of (cluster, component) rows."""
    steps = []
    for r in range(rounds):
        steps.append(f"""
        near{r} AS (
            SELECT w.n, c.k FROM whole w CROSS JOIN c{r} c QUALIFY 1 = row_number() OVER (
                PARTITION BY w.n ORDER BY list_dot_product(c.c, c.c) - 2 * list_dot_product(w.v, c.c), c.k)
        ), moved{r} AS (
            SELECT k, list(m ORDER BY d) AS c FROM (
                SELECT k, d, floor(sum(x) / count(*)) AS m FROM (
                    SELECT near{r}.k, unnest(w.v) AS x, unnest(range(64)) AS d FROM near{r} JOIN whole w USING (n)
                ) GROUP BY k, d) GROUP BY k
        ), c{r + 1} AS (
            SELECT k, coalesce(moved{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN moved{r} USING (k)
        ),""")
    return f"""
        WITH whole AS MATERIALIZED (
            SELECT row_number() OVER () AS n, vec_id,
                   list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
            FROM embeddings WHERE len(embedding) = 64
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS (
            SELECT row_number() OVER (ORDER BY h) - 1 AS k, v AS c
            FROM (SELECT v, sha256('1:' || vec_id) AS h FROM whole ORDER BY h LIMIT 16)
        ),{"".join(steps)}
        measured AS (
            SELECT w.n, w.vec_id, c.k, CAST(list_dot_product(w.v, w.v) - 2 * list_dot_product(w.v, c.c)
                                            + list_dot_product(c.c, c.c) AS BIGINT) AS d
            FROM whole w CROSS JOIN c{rounds} c
        ), last AS (
            SELECT n, vec_id, k, d FROM measured
            QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, k) = 1
        )
        SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance,
               CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(list_transform(c.c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
        FROM last JOIN c{rounds} c USING (k)
    """

ORACLE: dict[str, str] = {
    "op5_exact_dedup": r"""
        WITH normal AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        ), ranked AS (
            SELECT doc_id, norm, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) AS place
            FROM normal WINDOW same AS (PARTITION BY norm)
        )
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM ranked
    """,
    "op10_exact_top_k": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
        )
        SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
    """,
    "op11_centroid_clustering": _clustering_sql(3),
    # every order is applied to every kind of failing document, step by step
    "op13_filter_audit": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                   doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good,
                   doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
            FROM documents
        ), failing AS (
            SELECT part, good, toxic,
                   concat(CASE WHEN len(words) < 50 THEN 'A' END,
                          CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' END,
                          CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' END,
                          CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
                          CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' END) AS fails
            FROM texts
        ), kinds AS (
            SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
            FROM failing GROUP BY part, fails
        ), letter AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
        ), orders AS (
            SELECT concat(a.x, b.x, c.x, d.x, e.x) AS o
            FROM letter a JOIN letter b ON b.x <> a.x JOIN letter c ON c.x NOT IN (a.x, b.x)
                JOIN letter d ON d.x NOT IN (a.x, b.x, c.x) JOIN letter e ON e.x NOT IN (a.x, b.x, c.x, d.x)
        ), steps AS (
            SELECT o, s, substr(o, s, 1) AS f, substr(o, 1, s) AS so_far, substr(o, 1, s - 1) AS earlier
            FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)
        ), met AS (
            SELECT part, o, s, f, n, n_good, n_toxic, contains(fails, f) AS fails_it, fails = f AS only_it,
                   fails <> '' AND regexp_matches(so_far, '[' || fails || '-]') AS gone,
                   fails <> '' AND regexp_matches(earlier, '[' || fails || '-]') AS gone_before
            FROM kinds, steps
        ), counted AS (
            SELECT part, o, s, f, coalesce(sum(n) FILTER (NOT gone), 0) AS kept,
                   coalesce(sum(n) FILTER (gone AND NOT gone_before), 0) AS removed,
                   coalesce(sum(n) FILTER (fails_it AND gone_before), 0) AS redundant,
                   coalesce(sum(n) FILTER (only_it), 0) AS unique_fails,
                   coalesce(sum(n_good) FILTER (gone AND NOT gone_before), 0) AS good_lost,
                   coalesce(sum(n_toxic) FILTER (gone AND NOT gone_before), 0) AS toxic_lost
            FROM met GROUP BY part, o, s, f
        )
        SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
               CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
               CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
        FROM counted
    """,
}
