"""Money columns and exact ratio arithmetic.

Amounts are carried as whole minor units (cents at the default scale) in
``decimal(28,0)``, whose sums are ``decimal(38,0)``: exact, independent of
partitioning and summation order (a double sum is not), and wide enough for an
order total that very many item rows repeat. The result is turned back into a
double only at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: prices are stated to two decimal places.
MONEY_SCALE = 2
WHOLE = "decimal(38,0)"


def parse_money(col: Column | str, prefix: str = "R", decimal_mark: str = ",", strict: bool = True) -> Column:
    """``'R24,50'`` -> ``24.5``: drop every ``prefix``, turn the decimal mark into ``.``, cast.

    ``strict`` casts under ANSI rules, so malformed text fails the job (as a
    warehouse CAST does); ``strict=False`` gives NULL instead, for audits.
    """
    c = F.col(col) if isinstance(col, str) else col
    text = F.replace(F.replace(c, F.lit(prefix), F.lit("")), F.lit(decimal_mark), F.lit("."))
    return text.cast("double") if strict else text.try_cast("double")


def to_cents(col: Column | str, scale: int = MONEY_SCALE) -> Column:
    """Amount -> whole units of 10**-scale (``decimal(28,0)``), rounding away the binary noise of the double."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c * 10**scale).cast("decimal(28,0)")


def cents_to_amount(cents: Column, scale: int = MONEY_SCALE) -> Column:
    """Whole units -> amount (double); one correctly rounded division."""
    return cents.cast("double") / F.lit(10**scale)


def mean_amount(cents_sum: Column, n: Column, scale: int = MONEY_SCALE) -> Column:
    """Mean amount from an exact sum of whole units and a row count (double)."""
    return cents_sum.cast("double") / (n * F.lit(10**scale))


def small_floor_div(n: Column, d: Column | int) -> Column:
    """floor(n / d) for integers with |n| < 2**53 and d >= 1 (bigint).

    Exact: n and d are exact doubles, and a true quotient k - j/d (j >= 1)
    lies further below k than half an ulp of k whenever |n| < 2**53. One
    reference to ``n``, so no expression is duplicated.
    """
    return F.floor(n / (F.lit(d) if isinstance(d, int) else d))


def floor_div(n: Column, d: Column) -> Column:
    """Exact floor(n / d) for whole n and d >= 1 of up to 32 digits (``decimal(38,0)``).

    n less its remainder is a multiple of d, so the decimal division is exact.
    """
    whole = n.cast(WHOLE)
    return ((whole - F.pmod(whole, d.cast(WHOLE))) / d.cast(WHOLE)).cast(WHOLE)


def round_ratio(num: Column, den: Column, places: int) -> Column:
    """num / den rounded half away from zero to ``places`` decimals, exactly.

    ``num`` and ``den`` are whole numbers (counts, cents) of up to 32 digits.
    Rounding happens on the exact rational, not on a double, so the result does
    not depend on how a binary fraction happens to fall. NULL when ``den`` is 0
    or either side is NULL.
    """
    scale = 10**places
    an = F.abs(num.cast(WHOLE))
    ad = F.abs(den.cast(WHOLE))
    # a zero divisor must not be reached: ANSI division raises before the outer condition is looked at
    double = F.when(ad > 0, ad * F.lit(2))
    k = floor_div(an * F.lit(2 * scale) + ad, double).cast("double")
    negative = (num < 0) != (den < 0)
    return F.when(den != 0, F.when(negative & (num != 0), -k).otherwise(k) / F.lit(scale))
