"""Data profiling, extremes and quality rules (O2, O3, O5).

Counts, sums and extremes come from one aggregation pass over the table, turned
into a long table (one row per column) from that single aggregated row, never
by scanning once per column. Distinct counts come from unpivoted rows of typed
values, which collapse before they are exchanged; quartiles from passes that
count ranges, which exchange no values at all.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.money import round_ratio
from tillroll.session import local_table


def _long_from_row(agg_row: DataFrame, per_column: dict[str, list[Column]], names: list[str]) -> DataFrame:
    """Turn one aggregated row into one row per profiled column."""
    structs = [F.struct(F.lit(col).alias("column_name"), *[c.alias(n) for c, n in zip(vals, names)])
               for col, vals in per_column.items()]
    return agg_row.select(F.explode(F.array(*structs)).alias("__r")).select("__r.*")


def null_audit(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: ``nulls_in_<column>`` for every column."""
    cols = columns or df.columns
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"nulls_in_{c}") for c in cols])


def null_percent(df: DataFrame, columns: list[str] | None = None, places: int = 2) -> DataFrame:
    """``column_name, null_count, null_percent`` (percent of rows, rounded)."""
    cols = columns or df.columns
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(f"__z{i}") for i, c in enumerate(cols)])
    per = {c: [F.col(f"__z{i}"), round_ratio(F.col(f"__z{i}") * 100, F.col("__n"), places)] for i, c in enumerate(cols)}
    return _long_from_row(row, per, ["null_count", "null_percent"])


def non_null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column_name, data_type, non_null_count, row_count`` (what a table info listing shows)."""
    cols = columns or df.columns
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(f"__v{i}") for i, c in enumerate(cols)])
    per = {c: [F.lit(types[c]), F.col(f"__v{i}"), F.col("__n")] for i, c in enumerate(cols)}
    return _long_from_row(row, per, ["data_type", "non_null_count", "row_count"])


def _cell(df: DataFrame, c: str) -> tuple[str, Column]:
    """The class of a column's type and its value as that type: whole numbers, days, instants and truth values as
    ``bigint``, the others as they are. Texts need no cast; types without an order are compared by their JSON."""
    x, dt = F.col(c), df.schema[c].dataType
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return "double", x.cast("double")  # grouping makes -0.0 and 0.0 one, and all NaN
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "bigint", x.cast("bigint")
    if isinstance(dt, T.DateType):
        return "bigint", F.unix_date(x).cast("bigint")
    if isinstance(dt, T.TimestampType):
        return "bigint", F.unix_micros(x)
    if isinstance(dt, (T.StringType, T.BinaryType, T.DecimalType, T.TimestampNTZType)):
        return dt.simpleString(), x
    return "string", F.when(x.isNotNull(), F.to_json(F.struct(x.alias("v"))))


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column_name, distinct_count``: ``COUNT(DISTINCT)`` of every column (NULLs not counted; -0.0 and 0.0 are one
    value, and so are all NaN).

    One read of the input. Each row becomes a narrow row per column, with the value in the field of its type;
    equal values collapse before they are exchanged, then the distinct ones are counted.
    """
    cols = columns or df.columns
    cells = {c: _cell(df, c) for c in cols}
    kinds = sorted({kind for kind, _ in cells.values()})

    def row(i: int, c: str) -> Column:
        kind, value = cells[c]
        return F.struct(F.lit(i).alias("__i"), *((value if k == kind else F.lit(None).cast(k)).alias(f"__v{j}")
                                                 for j, k in enumerate(kinds)))

    rows = df.select(F.explode(F.array(*(row(i, c) for i, c in enumerate(cols)))).alias("__c")).select("__c.*")
    values = [f"__v{j}" for j in range(len(kinds))]
    some = reduce(or_, (F.col(v).isNotNull() for v in values))
    counts = rows.where(some).distinct().groupBy("__i").agg(F.count(F.lit(1)).alias("distinct_count"))
    names = local_table(df.sparkSession, list(enumerate(cols)), "__i int, column_name string")
    # one row for each column
    return names.join(F.broadcast(counts), "__i", "left").orderBy("__i").select(
        "column_name", F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"))


QUARTILES = (25, 50, 75)
_CUTS = 256      # ranges that a pass counts in each open bracket
_SKETCH = 2_000  # accuracy of the cuts; any cuts give the same result
_NEAR = 2 / _SKETCH  # how far from a quartile the first cuts are
_LAST = 10_000   # values of a bracket that one aggregate may list
_MANY = 1 << 62  # values of a bracket that has not been counted


def _number(x: float) -> str:
    """A double as SQL."""
    return f"double('{x}')" if math.isinf(x) else f"{x!r}D"


def _cuts(column: str, shares: list[float]) -> str:
    """Approximate quantiles of a column, as SQL."""
    return f"percentile_approx({column}, array({', '.join(map(_number, shares))}), {_SKETCH})"


class _Rank:
    """One order statistic: the value of the given rank (from 0) of a column's numbers lies in the bracket from ``low``
    to ``high``, which has about ``n`` values between its ends; or it is ``found``."""

    def __init__(self, column: int, rank: int, low: float, high: float, n: float):
        self.column, self.rank, self.low, self.high, self.n = column, rank, low, high, n
        self.found: float | None = None

    @property
    def bracket(self) -> tuple[int, float, float]:
        return self.column, self.low, self.high

    def answer(self, below: int, at_low: int, inside: int, at_high: int, values: list[float] | None, listed: bool,
               ends: tuple[float, float]) -> None:
        """What a pass counted: values under the bracket, at its ends and in it; and those, or cuts of them."""
        place = self.rank - below
        if 0 <= place < at_low:
            self.found = self.low
        elif at_low + inside <= place < at_low + inside + at_high:
            self.found = self.high
        elif at_low <= place < at_low + inside:
            if listed:
                self.found = values[place - at_low]
            else:
                # between two cuts around the rank, with room for the error of the sketch
                at, room = (place - at_low) * _CUTS // inside, 1 + 2 * _CUTS // _SKETCH
                self.low, self.high = values[max(at - room, 0)], values[min(at + 1 + room, _CUTS)]
                self.n = inside * ((2 * room + 1) / _CUTS + 4 / _SKETCH)
        elif place < 0:  # outside the bracket: the sketch was further off than it says
            self.low, self.high, self.n = ends[0], self.low, _MANY
        else:
            self.low, self.high, self.n = self.high, ends[1], _MANY


def _count_ranges(df: DataFrame, brackets: list[tuple[int, float, float]], listed: list[bool]) -> list[list]:
    """One pass over the columns ``__x0``, ... for all brackets (see ``_Rank.answer``). As SQL, one text an aggregate: the
    many small expressions would each cross to the JVM."""
    shares = [k / _CUTS for k in range(_CUTS + 1)]
    inside, aggs = ["*"], []
    for i, ((c, low, high), whole) in enumerate(zip(brackets, listed, strict=True)):
        x, least, most = f"__x{c}", _number(low), _number(high)
        aggs += [f"count_if({x} < {least})", f"count_if({x} = {least})"]
        if low < high:
            inside.append(f"if({x} > {least} AND {x} < {most}, {x}, NULL) AS __in{i}")
            aggs += [f"count(__in{i})", f"count_if({x} = {most})",
                     f"sort_array(collect_list(__in{i}))" if whole else _cuts(f"__in{i}", shares)]
        else:
            aggs += ["0", "0", "NULL"]
    row = df.selectExpr(*inside).selectExpr(*(f"{a} AS a{i}" for i, a in enumerate(aggs))).first()
    return [list(row[5 * i:5 * i + 5]) for i in range(len(brackets))]


def _order_statistics(df: DataFrame, ranks: list[_Rank], ends: list[tuple[float, float]]) -> None:
    """Finds the ranks exactly by counting ranges: every pass is one aggregation over the input, without an exchange of
    values, that narrows all brackets at once by a factor of some fifty; a bracket of a few thousand values is listed
    in the last one."""
    while True:
        sizes: dict[tuple[int, float, float], float] = {}  # ranks may share a bracket
        for r in ranks:
            if r.found is None:
                sizes[r.bracket] = max(r.n, sizes.get(r.bracket, 0))
        if not sizes:
            return
        listed = {key: n <= _LAST for key, n in sizes.items()}
        answers = dict(zip(sizes, _count_ranges(df, list(sizes), list(listed.values())), strict=True))
        for r in ranks:
            if r.found is None:
                key = r.bracket
                r.answer(*answers[key], listed[key], ends[r.column])


def _described(df: DataFrame, cols: list[str], more: list[Column]) -> tuple[Row, DataFrame, list[list[float | None]]]:
    """The one row of the aggregates ``more``, also as a table, and of each numeric column the values on both sides of its quartiles. The
    first pass gives the aggregates and the first brackets; NaN ranks above all other values."""
    numbers = df.select("*", *(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"__x{i}")
                               for i, c in enumerate(cols)))
    shares = [min(max(q / 100 + side, 0.0), 1.0) for q in QUARTILES for side in (-_NEAR, _NEAR)]
    first = []
    for i, c in enumerate(cols):
        x = f"__x{i}"
        first += [F.count(x).alias(f"__r{i}"), F.count(c).alias(f"__a{i}"), F.min(x).alias(f"__b{i}"),
                  F.max(x).alias(f"__t{i}"), F.expr(_cuts(x, shares)).alias(f"__c{i}")]
    counted = numbers.agg(*more, *first)
    row = counted.first()
    sides: list[list[_Rank | float]] = [[] for _ in cols]
    for i in range(len(cols)):
        n, values, cuts = row[f"__r{i}"], row[f"__a{i}"], row[f"__c{i}"]
        for k, q in enumerate(QUARTILES if values else ()):
            for rank in ((values - 1) * q // 100, -(-(values - 1) * q // 100)):
                if rank >= n:
                    sides[i].append(float("nan"))
                elif values == n:
                    sides[i].append(_Rank(i, rank, cuts[2 * k], cuts[2 * k + 1], n * (2 * _NEAR + 4 / _SKETCH) + 8))
                else:  # the quartiles of all values are not those of the numbers
                    sides[i].append(_Rank(i, rank, row[f"__b{i}"], row[f"__t{i}"], n))
    ranks = [r for own in sides for r in own if isinstance(r, _Rank)]
    _order_statistics(numbers, ranks, [(row[f"__b{i}"], row[f"__t{i}"]) for i in range(len(cols))])
    own = len(more)
    known = local_table(df.sparkSession, [tuple(row)[:own]], T.StructType(counted.schema.fields[:own]))
    return row, known, [[r.found if isinstance(r, _Rank) else r for r in own] or [None] * 6 for own in sides]


def _quartiles(n: str) -> list[Column]:
    """The quartiles by linear interpolation between the columns ``__lo25``, ``__hi25``, ..."""
    out = []
    for q in QUARTILES:
        lo, hi = F.col(f"__lo{q}"), F.col(f"__hi{q}")
        out.append(F.round(lo + (hi - lo) * ((F.col(n) - 1) * q % 100) / 100, 6).alias(f"q{q}"))
    return out


_SIDES = [f"__{side}{q}" for q in QUARTILES for side in ("lo", "hi")]


def numeric_describe(df: DataFrame, columns: list[str] | None = None, scales: dict[str, int] | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear interpolation) and max per numeric column.

    ``scales`` gives the number of decimals a column is exact to (0 for
    integers, 2 for prices; integer types up to 32 bits default to 0). Such
    columns get an exact mean and standard deviation from integer sums,
    independent of how the rows are partitioned (values beyond decimal(38,0)
    fail loudly); other columns use ``stddev_samp``. Quartiles are exact: they
    are found by counting ranges, two or three aggregations over the input when
    this is called, and nothing that grows with the rows is exchanged or collected.
    """
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]
    stats, _ = _numeric_table(df, cols, dict(scales or {}), [])
    return stats.select("column_name", "count", "mean", "std", "min", *_quartiles("count"), "max")


def _numeric_table(df: DataFrame, cols: list[str], scales: dict[str, int], more: list[Column]) -> tuple[DataFrame, object]:
    """A row for each numeric column with its statistics and the values beside its quartiles; and the one row of the
    aggregates ``more``."""
    aggs, per, names = list(more), {}, ["count", "mean", "std", "min", "max"]
    for i, c in enumerate(cols):
        aggs.append(F.count(c).alias(f"__n{i}"))
        own, stats = _numeric_stats(df, c, i, F.col(f"__n{i}"), scales)
        aggs += own
        per[c] = [F.col(f"__n{i}")] + [v for _, v in stats]
    row, known, sides = _described(df, cols, aggs)
    per = {c: [*stats, *(F.lit(v).cast("double") for v in own)] for (c, stats), own in zip(per.items(), sides)}
    return _long_from_row(known, per, [*names, *_SIDES]), row


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _numeric_stats(df: DataFrame, c: str, i: int, n: Column, scales: dict[str, int]) -> tuple[list[Column], list[tuple[str, Column]]]:
    """Aggregates to add for numeric column ``c`` (number ``i``; ``n`` its non-null
    count) and the metrics read from them: mean, std, min, max."""
    x = F.col(c)
    aggs = [F.min(c).cast("double").alias(f"__lo{i}"), F.max(c).cast("double").alias(f"__hi{i}")]
    scale = _exact_scale(df, c, scales)
    if scale is not None:
        xi = F.round(x * (10**scale)).cast("long").cast("decimal(38,0)")
        aggs += [F.sum(xi).alias(f"__s{i}"), F.sum(xi * xi).alias(f"__ss{i}")]
        s_, ss = F.col(f"__s{i}"), F.col(f"__ss{i}")
        nd = n.cast("decimal(38,0)")
        mean = s_.cast("double") / (n * (10**scale))
        std = F.when(n > 1, F.sqrt((nd * ss - s_ * s_).cast("double") / (nd * (nd - 1)).cast("double")) / (10**scale))
    else:
        aggs += [F.avg(x.cast("double")).alias(f"__m{i}"), F.stddev_samp(x.cast("double")).alias(f"__sd{i}")]
        mean, std = F.col(f"__m{i}"), F.col(f"__sd{i}")
    return aggs, [("mean", mean), ("std", std), ("min", F.col(f"__lo{i}")), ("max", F.col(f"__hi{i}"))]


def _exact_scale(df: DataFrame, c: str, scales: dict[str, int]) -> int | None:
    """Decimals a column is exact to, for the exact mean / std path: as given in
    ``scales``, else 0 for integer types up to 32 bits (whose squares summed
    stay far inside decimal(38,0)); other columns use floating statistics."""
    dt = df.schema[c].dataType
    return scales.get(c, 0 if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType)) else None)


def profile(df: DataFrame, columns: list[str] | None = None, scales: dict[str, int] | None = None) -> DataFrame:
    """Everything a first look at a table reports, as one long table
    ``column_name, metric, value`` (value as double).

    Every column: ``rows``, ``non_null``, ``nulls``, ``null_pct`` (rounded to 2
    places), ``distinct`` (NULLs not counted). Numeric columns add ``mean``,
    ``std``, ``min``, ``q25``, ``q50``, ``q75``, ``max`` as in
    :func:`numeric_describe`.
    """
    cols = columns or df.columns
    numeric = [c for c in cols if isinstance(df.schema[c].dataType, _NUMERIC)]
    counts = [F.count(F.lit(1)).alias("__rows"), *(F.count(c).alias(f"__v{i}") for i, c in enumerate(cols))]
    if numeric:
        stats, row = _numeric_table(df, numeric, dict(scales or {}), counts)
        stats = stats.select("column_name", "mean", "std", "min", *_quartiles("count"), "max")
    else:
        stats, row = None, df.agg(*counts).first()
    held = local_table(df.sparkSession, [(c, row["__rows"], row[f"__v{i}"]) for i, c in enumerate(cols)],
                       "column_name string, rows bigint, non_null bigint")
    nulls = F.col("rows") - F.col("non_null")
    held = held.select("column_name", *(c.cast("double").alias(name) for name, c in {
        "rows": F.col("rows"), "non_null": F.col("non_null"), "nulls": nulls,
        "null_pct": round_ratio(nulls * 100, F.col("rows"), 2)}.items()))
    out = held.unpivot("column_name", held.columns[1:], "metric", "value")
    out = out.unionByName(distinct_counts(df, cols).select(
        "column_name", F.lit("distinct").alias("metric"), F.col("distinct_count").cast("double").alias("value")))
    if stats is not None:
        out = out.unionByName(stats.unpivot("column_name", stats.columns[1:], "metric", "value"))
    return out


def value_counts(df: DataFrame, column: str, mode: str = "sql", count_name: str = "count",
                 by_count: bool = False) -> DataFrame:
    """Rows per value of ``column``, in order of value or, ``by_count``, most frequent first (ties by value).

    ``mode="sql"``: ``GROUP BY column`` with ``COUNT(column)``, so a NULL group
    shows 0. ``"dropna"``: NULLs left out. ``"keepna"``: NULL is a value with its
    row count.
    """
    if mode == "sql":
        out = df.groupBy(column).agg(F.count(column).alias(count_name))
    elif mode == "dropna":
        out = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(count_name))
    elif mode == "keepna":
        out = df.groupBy(column).agg(F.count(F.lit(1)).alias(count_name))
    else:
        raise ValueError(f"mode must be 'sql', 'dropna' or 'keepna', not {mode!r}")
    return out.orderBy(F.desc(count_name), F.asc(column)) if by_count else out.orderBy(column)


def crosstab(df: DataFrame, first: str | Column, second: str | Column, count_of: str | None = None,
             count_name: str = "total_count", order_by: list[str] | None = None) -> DataFrame:
    """Long-form two-way table: rows per (first, second); counts ``count_of`` when
    given; in order of ``order_by`` (default: first, second)."""
    n = F.count(F.lit(1)) if count_of is None else F.count(count_of)
    out = df.groupBy(first, second).agg(n.alias(count_name))
    return out.orderBy(*(order_by or out.columns[:2]))


def functional_dependency(df: DataFrame, determinant: str, dependent: str,
                          count_name: str = "unique_sort_count") -> DataFrame:
    """Distinct ``dependent`` values per ``determinant``; 1 everywhere means it holds."""
    return df.groupBy(determinant).agg(F.countDistinct(dependent).alias(count_name))


def dependency_pairs(df: DataFrame, columns: list[str], dependents: list[str] | None = None) -> DataFrame:
    """Every functional dependency between two columns at once: ``determinant, dependent, groups, broken_groups,
    rows_to_remove, remove_percent, holds``.

    ``groups`` are the values of the determinant, ``broken_groups`` those with more than one value of the dependent;
    ``rows_to_remove`` is the least number of rows without which it would hold, ``remove_percent`` (2 places) their
    share. NULL is a value as any other. ``dependents`` are checked against ``columns`` (default: among themselves).

    The rows are counted once by all these columns; pairs are unpivoted from the counted combinations, so every pair
    costs rows in the number of combinations, not of rows.
    """
    others = columns if dependents is None else dependents
    pairs = [(a, b) for a in columns for b in others if a != b]
    counted = df.groupBy(*dict.fromkeys([*columns, *others])).agg(F.count(F.lit(1)).alias("__n"))

    def value(c: str) -> Column:
        kind, x = _cell(df, c)
        return F.coalesce(F.concat(F.lit("v"), (x + F.lit(0.0) if kind == "double" else x).cast("string")), F.lit("null"))

    cells = [F.struct(F.lit(i).alias("__i"), value(a).alias("x"), value(b).alias("y")) for i, (a, b) in enumerate(pairs)]
    per = counted.select("__n", F.explode(F.array(*cells)).alias("c")).groupBy("c.__i", "c.x", "c.y").agg(F.sum("__n").alias("n"))
    per = per.groupBy("__i", "x").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count(F.lit(1)).alias("values"))
    per = per.groupBy("__i").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("values") > 1).alias("broken_groups"),
                                 F.sum(F.col("n") - F.col("most")).alias("rows_to_remove"), F.sum("n").alias("rows"))
    names = local_table(df.sparkSession, [(i, a, b) for i, (a, b) in enumerate(pairs)],
                        "__i int, determinant string, dependent string")
    zero = F.lit(0).cast("bigint")  # an empty table breaks nothing
    held = names.join(F.broadcast(per), "__i", "left").orderBy("__i")
    return held.select("determinant", "dependent", *(F.coalesce(c, zero).alias(c) for c in ("groups", "broken_groups", "rows_to_remove")),
                       F.coalesce(round_ratio(F.col("rows_to_remove") * 100, F.col("rows"), 2), F.lit(0.0)).alias("remove_percent"),
                       (F.coalesce("broken_groups", zero) == 0).alias("holds"))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """Any ``n`` rows (a look at the data; which rows is not defined)."""
    return df.limit(n)


def extremes(df: DataFrame, expr: str | Column, k: int = 10, desc: bool = False, name: str | None = None) -> DataFrame:
    """The ``k`` smallest (or largest) values of an expression: a distributed top-k.

    SQL ordering: NULLs come first ascending and last descending, as in the
    original warehouse; filter them out first to see only real values.
    """
    c = F.col(expr) if isinstance(expr, str) else expr
    name = name or (expr if isinstance(expr, str) else "value")
    out = df.select(c.alias(name))
    return out.orderBy(F.desc(name) if desc else F.asc(name)).limit(k)


def check_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule, violations``: one row per rule, each rule a condition that flags a bad row.

    All rules are counted in one pass.
    """
    row = df.agg(*[F.count_if(cond).alias(f"__r{i}") for i, cond in enumerate(rules.values())])
    structs = [F.struct(F.lit(name).alias("rule"), F.col(f"__r{i}").alias("violations")) for i, name in enumerate(rules)]
    return row.select(F.explode(F.array(*structs)).alias("__x")).select("__x.*")


def rule_rows(df: DataFrame, condition: Column, columns: list[str | Column] | None = None) -> DataFrame:
    """The rows that break a rule (optionally projected)."""
    out = df.filter(condition)
    return out.select(*columns) if columns else out
