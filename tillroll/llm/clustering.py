"""Centroid clustering with exact integers, nearest centroids found by the threshold algorithm.

Every dimension has a list of the centroids sorted by their value there. From a vector's own value each list is walked
outward, nearest first, one centroid a step. A centroid that is met for the first time gets its exact distance. What no
list has reached yet is at least as far as the sum of the squared distances at the lists' frontiers; once that sum is
strictly above the best exact distance, the vector is done (strictly, so that of equally near centroids all are met).

A batch of vectors walks together in numpy. Each round sums the vectors of a cluster in the tasks; only one sum for each
cluster and dimension leaves a task, and clusters x dimensions of them reach the driver, whatever the number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import materialize

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
LARGEST = 1 << 27  # of a component, so that distances and a task's sums fit 64 bits
ROWS_AT_ONCE = 2048


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance, exact distances taken) of each vector; of equally near
    centroids the smaller number."""
    k, d = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable").T  # (d, k): each list's centroids, by value
    lists = np.take_along_axis(centroids.T, order, axis=1)
    # values below and above every list, which are never the nearer one
    padded = np.concatenate([np.zeros((d, 1), np.int64), lists, np.zeros((d, 1), np.int64)], axis=1)
    numbers = np.concatenate([np.zeros((d, 1), np.int64), order, np.zeros((d, 1), np.int64)], axis=1)
    far = np.iinfo(np.int64).max
    dims = np.arange(d)
    n = len(vectors)
    best, where = np.full(n, far), np.full(n, k)
    taken = np.zeros(n, dtype=np.int64)
    # position in the padded list of the first centroid at or above the vector's value
    above = 1 + np.stack([np.searchsorted(lists[j], vectors[:, j], side="left") for j in range(d)], axis=1)
    below = above - 1
    met = np.zeros((n, k), dtype=bool)
    rows = np.arange(n)
    for _ in range(k):
        x = vectors[rows]
        down = np.where(below[rows] >= 1, x - padded[dims, below[rows]], far)
        up = np.where(above[rows] <= k, padded[dims, np.minimum(above[rows], k)] - x, far)
        lower = down <= up
        number = numbers[dims, np.where(lower, below[rows], np.minimum(above[rows], k))]
        below[rows] -= lower
        above[rows] += ~lower
        frontier = np.minimum(down, up)
        seen = np.zeros((len(rows), k), dtype=bool)
        seen[np.arange(len(rows))[:, None], number] = True
        new = seen & ~met[rows]
        met[rows] |= seen
        for c in range(k):  # in order of number, so that a tie leaves the smaller one
            at = np.flatnonzero(new[:, c])
            if not len(at):
                continue
            away = x[at] - centroids[c]
            exact = np.einsum("ij,ij->i", away, away)
            own = rows[at]
            better = (exact < best[own]) | ((exact == best[own]) & (c < where[own]))
            best[own[better]], where[own[better]] = exact[better], c
            taken[own] += 1
        rows = rows[(frontier * frontier).sum(axis=1) <= best[rows]]
        if not len(rows):
            break
    return where, best, taken


def _matrix(batch: pa.RecordBatch, column: str, dimensions: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(batch.column(column).to_pylist()), dtype="<i8")
    return flat.reshape(batch.num_rows, dimensions)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(a, ROWS_AT_ONCE)


def _sums(centroids: np.ndarray) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = centroids.shape
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, d), dtype=np.int64)
        for batch in _slices(batches):
            vectors = _matrix(batch, "v", d)
            cluster, _, _ = nearest(vectors, centroids)
            count += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                total[c] += vectors[cluster == c].sum(axis=0)
        has = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(has, d), pa.int32()), pa.array(np.tile(np.arange(d), len(has)), pa.int32()),
             pa.array(np.repeat(count[has], d), pa.int64()), pa.array(total[has].reshape(-1), pa.int64())],
            ["cluster", "dim", "n", "total"])

    return work


def _assigned(centroids: np.ndarray) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            cluster, distance, _ = nearest(_matrix(batch, "v", centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                ["id", "cluster", "distance"])

    return work


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """``id`` and ``v``, the components as little-endian 64-bit integers floor(scale * x), of the vectors that have
    exactly ``dimensions`` components, none null or non-finite."""
    good = (F.size(F.col("x")) == dimensions) & ~F.exists(
        "x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where(good)
    id_type = rows.schema["id"].dataType.simpleString()

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dimensions)
            whole = np.floor(scale * x)
            if (np.abs(whole) > LARGEST).any():
                raise ValueError(f"a component beyond {LARGEST} / {scale}: distances would not fit 64 bits")
            rows = np.ascontiguousarray(whole.astype("<i8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "v"])

    return rows.mapInArrow(cast, f"id {id_type}, v binary")


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *,
                    clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE,
                    seed: int = 1) -> DataFrame:
    """Per vector: id, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    Vectors count if they have exactly ``dimensions`` components, none null or non-finite; component x becomes
    floor(scale * x). The first centroids are the vectors with the smallest SHA-256 of ``seed:id``, in that order (a
    null id counts as empty text; rows with one id are different vectors, in order of their components). Each round
    assigns all vectors to the nearest centroid (squared distance; ties: smaller number) and moves every centroid that
    has vectors to the floor of their mean; then all are assigned once more. With fewer vectors than clusters each is a
    centroid; no vectors give an empty result. A component over 2^27 / scale is an error, as distances would not fit a
    long. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = materialize(whole_vectors(vectors, id_col, vector_col, dimensions, scale), "cluster_vectors")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    start = rows.orderBy(F.sha2(name.cast("binary"), 256), "v").limit(clusters).collect()
    if not start:
        return rows.select(F.col("id").alias(id_col), *(F.lit(0).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"),
            ("centroid_sha256", "string"))))
    centroids = np.stack([np.frombuffer(bytes(r["v"]), dtype="<i8") for r in start]).astype(np.int64)
    for _ in range(rounds):
        sums = rows.mapInArrow(_sums(centroids), "cluster int, dim int, n bigint, total bigint")
        for r in sums.groupBy("cluster", "dim").agg(F.sum("n").alias("n"),
                                                    F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
            centroids[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    assigned = materialize(rows.mapInArrow(
        _assigned(centroids), f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance bigint"), "clusters")
    inertia = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of_cluster = spark.createDataFrame(
        [(c, d, sum(inertia.values()), hashes[c]) for c, d in sorted(inertia.items())],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # one row for each cluster
    return assigned.join(F.broadcast(of_cluster), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
