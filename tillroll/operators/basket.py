"""Basket analysis: co-purchased pairs (O11) and association rules (O12).

A pair (A, B), A < B, counts the baskets that hold both. One exact method for
every catalogue size: each basket becomes its set of distinct items, baskets
are counted per distinct set, and pairs, per-item counts and the basket total
all come from that table, each set expanded once and weighted by its count. So
repeated rows collapse before their shuffle, baskets that hold the same items
are paired once, and the input is read once. Sets expand by a join of their
(set, item) rows on the set, so that adaptive execution can split a set with
very many items across tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def basket_sets(tx: DataFrame, basket: str = "order_id", item: str = "coffee_name") -> DataFrame:
    """``__set`` (id), ``__items`` (distinct items, in order), ``__baskets`` (how many baskets hold just these).

    Baskets without an id are left out; items that are NULL count for the
    basket but never pair, so a basket of them only is the empty set. The id
    is a SHA-256 of the items.
    """
    rows = (tx.select(F.col(basket).alias("__basket"), F.col(item).alias("__item"))
              .filter(F.col("__basket").isNotNull()))
    per = rows.groupBy("__basket").agg(F.sort_array(F.collect_set("__item")).alias("__items"))
    sets = per.groupBy("__items").agg(F.count(F.lit(1)).alias("__baskets"))
    return sets.select(F.sha2(F.to_json(F.struct("__items")), 256).alias("__set"), "__items", "__baskets")


def _set_items(sets: DataFrame) -> DataFrame:
    return sets.select("__set", "__baskets", F.explode("__items").alias("__item"))


def _pairs(sets: DataFrame, a: str, b: str, count_name: str) -> DataFrame:
    rows = _set_items(sets)
    left = rows.select("__set", "__baskets", F.col("__item").alias(a))
    right = rows.select("__set", F.col("__item").alias(b))
    return (left.join(right, on="__set", how="inner")
                .filter(F.col(a) < F.col(b))
                .groupBy(a, b)
                .agg(F.sum("__baskets").alias(count_name)))


def _top(out: DataFrame, k: int | None, count_name: str, a: str, b: str) -> DataFrame:
    return out if k is None else out.orderBy(F.desc(count_name), F.asc(a), F.asc(b)).limit(k)


def pair_counts(
    tx: DataFrame,
    basket: str = "order_id",
    item: str = "coffee_name",
    k: int | None = 10,
    names: tuple[str, str] = ("product_a", "product_b"),
    count_name: str = "co_occurrence_count",
) -> DataFrame:
    """Pairs of items bought in the same basket, most frequent first (top ``k``,
    ties broken by the item names)."""
    a, b = names
    return _top(_pairs(basket_sets(tx, basket, item), a, b, count_name), k, count_name, a, b)


def pair_rules(
    tx: DataFrame,
    basket: str = "order_id",
    item: str = "coffee_name",
    k: int | None = 10,
    names: tuple[str, str] = ("coffee_a", "coffee_b"),
    count_name: str = "co_occurrence_count",
) -> DataFrame:
    """Support, confidence both ways and lift of every pair, top ``k`` by pair count.

    N = distinct baskets; n(A) = baskets holding A. support = n(AB)/N,
    confidence A->B = n(AB)/n(A), B->A = n(AB)/n(B),
    lift = support / ((n(A)/N) * (n(B)/N)). N is a one-row scalar subquery
    over the sets; the per-item counts have one row per item.
    """
    a, b = names
    sets = basket_sets(tx, basket, item)
    pairs = _pairs(sets, a, b, count_name)
    per_item = _set_items(sets).groupBy("__item").agg(F.sum("__baskets").alias("__n"))
    na = per_item.select(F.col("__item").alias(a), F.col("__n").alias("__na"))
    nb = per_item.select(F.col("__item").alias(b), F.col("__n").alias("__nb"))
    total = sets.agg(F.sum("__baskets")).scalar()
    j = pairs.join(na, on=a, how="inner").join(nb, on=b, how="inner").withColumn("__total", total)
    ab, cnt_a, cnt_b, total = F.col(count_name), F.col("__na"), F.col("__nb"), F.col("__total")
    out = j.select(
        a, b, count_name,
        (ab / total).alias("Support_AB"),
        (ab / cnt_a).alias("Confidence_A_to_B"),
        (ab / cnt_b).alias("Confidence_B_to_A"),
        ((ab / total) / ((cnt_a / total) * (cnt_b / total))).alias("Lift"),
    )
    return _top(out, k, count_name, a, b)
