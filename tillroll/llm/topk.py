"""Exact top-k search by inner product through a pivot-distance index.

Vectors get one more component so that all have the norm of the longest, M: then the largest inner products are the
least distances, since d(q, x)^2 = |q|^2 + M^2 - 2 q.x. The index keys each vector by its nearest pivot and its
distance to it, cut into rings (annuli) of equal width; a ring's rows are dealt to blocks of bounded size, so a vector
that a third of the rows repeat fills many blocks and no task holds more than one.

A query first searches the annuli with the best bounds until they hold enough rows. The k-th score it finds there
bounds the rest: by the triangle inequality d(q, x) >= |d(q, p) - d(x, p)|, so an annulus whose nearest edge is too far
for that score is skipped, and the others are searched. Scores are whole numbers, computed without rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import materialize

PIVOTS = 32
PIVOT_SAMPLE = 2048  # rows from which pivots are taken; every row is indexed
RINGS = 8
BLOCK_ROWS = 4096
BLOCK_QUERIES = 4096
EXACT = 2.0 ** 53


def _matrix(blobs: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype="<f8").reshape(len(blobs), size)


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers; those beyond 64 bits become the nearest 64-bit integer."""
    most = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, queries.shape[1])
    if most < EXACT:
        return (queries @ vectors.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in queries], [[int(x) for x in row] for row in vectors]
    least, largest = -2 ** 63, 2 ** 63 - 1
    return np.array([[max(least, min(largest, sum(a * b for a, b in zip(q, v, strict=True)))) for v in whole[1]]
                     for q in whole[0]], dtype=np.int64).reshape(len(queries), len(vectors))


def _spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n different rows of the sample, each far from those before it."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
                *, scale: int = 256, pivots: int = PIVOTS, rings: int = RINGS, block_rows: int = BLOCK_ROWS,
                block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: for each row of ``is_query`` the k other rows with the
    largest inner product of the vectors floor(scale * x); ties go to the smaller id.

    Vectors that are null or hold a null, NaN or infinite component take no part. Shorter vectors count as followed by
    zeros. A query skips its own row only: another row with the same id takes part, and is a query of its own. Null
    ids are no queries and lose ties. With fewer than k other rows all are returned. An empty table gives an empty
    result. Other columns are read only by ``is_query``.
    """
    spark = vectors.sparkSession
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(vec_col).isNotNull() & fine).select(
        F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(is_query & F.col(id_col).isNotNull(), F.lit(False)).alias("is_query"),
        F.col(vec_col).cast("array<double>").alias("vec"),
    )
    size = max(1, rows.agg(F.max(F.size("vec"))).first()[0] or 0)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            column = batch.column("vec")
            ends = np.cumsum(np.concatenate([[0], column.value_lengths().to_numpy()]))
            flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False))
            flat = np.concatenate([flat, np.zeros(size)])
            blobs, norms = [], []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                v = flat[a:b] if b - a == size else np.concatenate([flat[a:b], np.zeros(size - (b - a))])
                blobs.append((v + 0.0).astype("<f8").tobytes())
                norms.append(float(v @ v))
            keys = np.arange(key, key + len(blobs), dtype=np.int64)
            key += len(blobs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("is_query"), pa.array(keys), pa.array(norms, pa.float64()),
                 pa.array(blobs, pa.binary())], ["id", "is_query", "key", "norm2", "vec"])

    data = materialize(rows.mapInArrow(
        whole, "id bigint, is_query boolean, key bigint, norm2 double, vec binary"), "topk_vectors")
    most = float(data.agg(F.max("norm2")).first()[0] or 0.0)
    sample = data.select("vec").orderBy(F.xxhash64("key")).limit(PIVOT_SAMPLE).collect()
    centres = _spread(np.unique(_matrix([r["vec"] for r in sample], size), axis=0), pivots)
    centre_norms = (centres ** 2).sum(axis=1)
    slack = 1e-9 * (most + float(centre_norms.max(initial=0)) + 1.0)  # rounding of squared distances

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = centre_norms - 2 * (_matrix(batch.column("vec").to_pylist(), size) @ centres.T)
            pivot = near.argmin(axis=1)
            distance = np.sqrt(np.maximum(0, most + near[np.arange(len(pivot)), pivot]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "key", "vec")), pa.array(pivot, pa.int32()), pa.array(distance)],
                ["id", "key", "vec", "pivot", "distance"])

    index = materialize(data.select("id", "key", "vec").mapInArrow(
        keyed, "id bigint, key bigint, vec binary, pivot int, distance double"), "topk_index")
    edges = {r["pivot"]: (r["a"], max(r["b"] - r["a"], 1e-12)) for r in index.groupBy("pivot").agg(
        F.min("distance").alias("a"), F.max("distance").alias("b")).collect()}  # a row for each pivot
    if not edges:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    start = F.element_at(F.create_map(*(F.lit(x) for p, (a, _) in edges.items() for x in (p, a))), F.col("pivot"))
    width = F.element_at(F.create_map(*(F.lit(x) for p, (_, w) in edges.items() for x in (p, w))), F.col("pivot"))
    ring = F.least(F.lit(rings - 1), F.floor((F.col("distance") - start) / width * rings)).cast("int")
    celled = index.withColumn("cell", F.col("pivot") * rings + ring)
    cells = sorted(tuple(r) for r in celled.groupBy("cell").agg(
        F.count(F.lit(1)), F.min("distance"), F.max("distance")).collect())  # pivots * rings rows at most
    cell_ids = np.array([c[0] for c in cells])
    counts = np.array([c[1] for c in cells])
    inner, outer = np.array([c[2] for c in cells]), np.array([c[3] for c in cells])
    blocks = -(-counts // block_rows)
    block_of = F.element_at(F.create_map(*(F.lit(int(x)) for c, b in zip(cell_ids, blocks, strict=True) for x in (c, b))),
                            F.col("cell"))
    n_queries = data.where("is_query").count()
    # several tasks search a block that very many queries reach
    parts = max(1, -(-n_queries // block_queries))
    stored = celled.select("id", "key", "vec", "cell", F.pmod(F.xxhash64("key"), block_of).cast("int").alias("block"),
                           F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def bounds(queries: np.ndarray) -> np.ndarray:
        """No row of a cell scores more with the query than this."""
        norms = (queries ** 2).sum(axis=1)[:, None]
        to_pivot = np.sqrt(np.maximum(0, norms + centre_norms - 2 * (queries @ centres.T)))[:, cell_ids // rings]
        gap = np.maximum(0, np.maximum(inner - to_pivot, to_pivot - outer) - 1e-6)
        return (norms + most - gap ** 2) / 2 + slack

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block that a query searches: at first the best annuli, then those that its score allows."""
        for batch in batches:
            blobs = batch.column("vec").to_pylist()
            bound = bounds(_matrix(blobs, size))
            order = np.argsort(-bound, axis=1, kind="stable")
            held = np.cumsum(counts[order], axis=1)
            first = np.zeros(bound.shape, dtype=bool)  # the fewest annuli that hold k rows besides the query's
            np.put_along_axis(first, order, np.concatenate(
                [np.ones((len(blobs), 1), dtype=bool), held[:, :-1] < k + 1], axis=1), axis=1)
            if "least" in batch.schema.names:
                least = np.array([-np.inf if x is None else float(x) for x in batch.column("least").to_pylist()])
                go = ~first & (bound >= least[:, None])
            else:
                go = first
            q, c = np.nonzero(go)
            n = blocks[c]
            row = np.repeat(q, n)
            block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(take), batch.column("query_key").take(take),
                 pa.array([blobs[i] for i in row.tolist()], pa.binary()), pa.array(np.repeat(cell_ids[c], n), pa.int32()),
                 pa.array(block, pa.int32()), batch.column("part").take(take)],
                ["query_id", "query_key", "vec", "cell", "block", "part"])

    def search(stored_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "query_key": [], "vec_id": [], "score": []}
        if len(stored_rows) and len(query_rows):
            ids = stored_rows["id"].astype("float64" if stored_rows["id"].isna().any() else "int64")
            by_id = np.argsort(ids.fillna(np.inf).to_numpy(), kind="stable")
            keys, names = stored_rows["key"].to_numpy()[by_id], stored_rows["id"].to_numpy()[by_id]
            block = _matrix(list(stored_rows["vec"].to_numpy()[by_id]), size)
            for a in range(0, len(query_rows), 256):
                part = query_rows.iloc[a:a + 256]
                scores = _scores(_matrix(list(part["vec"]), size), block)
                for name, key, row in zip(part["query_id"], part["query_key"], scores, strict=True):
                    others = np.flatnonzero(keys != key)
                    row = row[others]
                    if len(row) > k:  # all rows that tie with the k-th best compete by id
                        least = np.partition(row, len(row) - k)[len(row) - k]
                        sure = np.flatnonzero(row > least)
                        best = np.concatenate([sure, np.flatnonzero(row == least)[:k - len(sure)]])
                    else:
                        best = np.arange(len(row))
                    out["query_id"] += [name] * len(best)
                    out["query_key"] += [key] * len(best)
                    out["vec_id"] += [None if pd.isna(x) else int(x) for x in names[others[best]]]
                    out["score"] += row[best].tolist()
        frame = pd.DataFrame(out)
        frame["vec_id"] = frame["vec_id"].astype("Int64")
        return frame

    def found(queries: DataFrame) -> DataFrame:
        asked = queries.mapInArrow(visits, "query_id bigint, query_key bigint, vec binary, cell int, block int, part int")
        place = ["cell", "block", "part"]
        return stored.groupBy(*place).cogroup(asked.groupBy(*place)).applyInPandas(
            search, "query_id bigint, query_key bigint, vec_id bigint, score bigint")

    best = Window.partitionBy("query_key").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    asked = data.where("is_query").select(F.col("id").alias("query_id"), F.col("key").alias("query_key"), "vec",
                                          F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"))
    early = materialize(found(asked).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"),
                        "topk_first")
    least = early.groupBy("query_key").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    late = found(asked.join(least, "query_key", "left").select("query_id", "query_key", "vec", "part", "least"))
    both = early.unionByName(late).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return both.select("query_id", "rank", "vec_id", "score")
