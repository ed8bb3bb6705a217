"""Time helpers that do not depend on the session time zone.

For ``timestamp_ntz`` columns, Spark's ``date_format``/``timestampdiff`` route
through the session zone (a DST gap moves 02:30 to 03:30). Wall-clock field
extraction (``hour``, ``to_date``, ``date_part``) and ``make_timestamp(..., 'UTC')``
do not, so elapsed time and text forms are built from those. For ``timestamp``
(instant) columns, ``unix_micros`` is already exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.money import small_floor_div


def is_ntz(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.TimestampNTZType)


def epoch_micros(ts: Column, ntz: bool) -> Column:
    """Microseconds since 1970-01-01 00:00 (wall clock for NTZ, instant otherwise)."""
    if not ntz:
        return F.unix_micros(ts)
    utc = F.make_timestamp(
        F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts),
        F.date_part(F.lit("SECOND"), ts), F.lit("UTC"),
    )
    return F.unix_micros(utc)


def epoch_seconds(ts: Column, ntz: bool) -> Column:
    """Whole seconds since 1970-01-01 00:00 (fraction dropped, floor).

    Cheaper than :func:`epoch_micros` and enough to find which ``n``-second
    bucket (n a whole number) a timestamp falls in.
    """
    if not ntz:
        return small_floor_div(F.unix_micros(ts), 1_000_000)
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def whole_seconds_between(start: Column, end: Column, ntz: bool) -> Column:
    """Whole elapsed seconds, truncated toward zero (299.9 s -> 299)."""
    diff = epoch_micros(end, ntz) - epoch_micros(start, ntz)
    whole = small_floor_div(F.abs(diff), 1_000_000)
    return F.when(diff >= 0, whole).otherwise(-whole)


def timestamp_text(ts: Column, ntz: bool, digits: int = 6) -> Column:
    """``yyyy-MM-dd HH:mm:ss.ffffff`` with exactly ``digits`` fraction digits."""
    if not ntz:
        frac = "." + "S" * digits if digits > 0 else ""
        return F.date_format(ts, f"yyyy-MM-dd HH:mm:ss{frac}")
    s = ts.cast("string")  # wall clock, trailing fraction zeros trimmed
    padded = F.rpad(F.when(F.length(s) == 19, F.concat(s, F.lit("."))).otherwise(s), 26, "0")
    return F.substring(padded, 1, 20 + digits) if digits > 0 else F.substring(padded, 1, 19)


def time_of_day_text(ts: Column, ntz: bool) -> Column:
    """``HH:mm:ss.ffffff`` part of :func:`timestamp_text`."""
    return F.substring(timestamp_text(ts, ntz, 6), 12, 15)
