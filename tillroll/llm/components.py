"""Connected components of a graph given by its edges, by alternating star contraction.

Every round replaces edges by shorter ones to the smallest neighbour (Kiveris et al., "Connected Components in
MapReduce and Beyond"); the edges end as stars around each component's smallest node. Only minima are aggregated and
joined back, so a node with very many neighbours is never gathered in one place. Each round is written to the shared
folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the component's smallest node) of every node of the edges ``u``, ``v`` (bigint).

    Edges may repeat, point either way or join a node to itself; a node of such an edge only is its own root.
    """
    alone = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .distinct(), "edges")
    mark = None
    while True:
        new = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == mark or not new[0]:
            break
        mark = new
        now = materialize(_small_star(_large_star(now).distinct()).distinct(), "edges")
    return alone.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"))
