"""Column functions: money parsing, exact rounding, time arithmetic."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.clock import epoch_micros, epoch_seconds, timestamp_text, time_of_day_text, whole_seconds_between
from tillroll.functions.keys import customer_key, period_key
from tillroll.functions.money import floor_div, parse_money, round_ratio, to_cents


def test_parse_money_strict_and_audit(spark):
    df = spark.createDataFrame([("R24,50",), ("24",), ("R1R2,05",), (None,)], "m string")
    got = [r[0] for r in df.select(parse_money("m")).collect()]
    assert got == [24.5, 24.0, 12.05, None]
    bad = spark.createDataFrame([("Rx",)], "m string")
    assert bad.select(parse_money("m", strict=False)).collect()[0][0] is None
    with pytest.raises(Exception):
        bad.select(parse_money("m")).collect()


def test_to_cents_removes_binary_noise(spark):
    df = spark.createDataFrame([(17.29,), (0.1 + 0.2,), (1234.56,)], "x double")
    assert [r[0] for r in df.select(to_cents("x")).collect()] == [1729, 30, 123456]


@pytest.mark.parametrize("num,den,places,expected", [
    (1, 800, 4, 0.0013),        # 0.00125 is a decimal half: rounds away from zero
    (-1, 800, 4, -0.0013),
    (1, 40, 2, 0.03),           # 0.025
    (16, 89, 2, 0.18),          # 17.98 % in the monthly retention golden, as a fraction
    (1600, 89, 2, 17.98),
    (0, 7, 2, 0.0),
    (-5, 10, 0, -1.0),
    (5, -10, 0, -1.0),
    (3, 0, 2, None),
    (123456789012, 7, 4, 17636684144.5714),
])
def test_round_ratio_exact(spark, num, den, places, expected):
    df = spark.createDataFrame([(num, den)], "n long, d long")
    got = df.select(round_ratio(F.col("n"), F.col("d"), places)).collect()[0][0]
    assert got == expected


def test_floor_div_large_values(spark):
    n = 2**62 + 12345
    df = spark.createDataFrame([(n, 7), (7, 7), (6, 7), (-1, 7)], "n long, d long")
    got = [r[0] for r in df.select(floor_div(F.col("n"), F.col("d"))).collect()]
    assert got == [n // 7, 1, 0, -1]


def test_whole_seconds_truncate(spark):
    rows = [(dt.datetime(2024, 1, 1, 10, 0, 0, 900000), dt.datetime(2024, 1, 1, 10, 5, 0, 100000)),
            (dt.datetime(2024, 1, 1, 10, 0, 0), dt.datetime(2024, 1, 1, 10, 5, 0)),
            (dt.datetime(2024, 1, 1, 10, 0, 0), dt.datetime(2024, 1, 1, 10, 4, 59, 999999)),
            (dt.datetime(2024, 1, 1, 10, 5, 0), dt.datetime(2024, 1, 1, 10, 0, 0, 500000))]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("a", T.TimestampNTZType()),
                                                   T.StructField("b", T.TimestampNTZType())]))
    got = [r[0] for r in df.select(whole_seconds_between(F.col("a"), F.col("b"), True)).collect()]
    assert got == [299, 300, 299, -299]


def test_time_helpers_ignore_session_zone(spark):
    """A wall-clock time inside a DST gap keeps its text and elapsed seconds."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00.12' AS t, timestamp_ntz'2024-03-10 01:59:59.5' AS t0")
        r = df.select(timestamp_text(F.col("t"), True, 6), timestamp_text(F.col("t"), True, 3),
                      time_of_day_text(F.col("t"), True), whole_seconds_between(F.col("t0"), F.col("t"), True),
                      epoch_micros(F.col("t"), True), epoch_seconds(F.col("t"), True)).collect()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert r[0] == "2024-03-10 02:30:00.120000"
    assert r[1] == "2024-03-10 02:30:00.120"
    assert r[2] == "02:30:00.120000"
    assert r[3] == 1800
    assert r[4] == 1710037800120000
    assert r[5] == 1710037800


def test_customer_key_and_period_keys(spark):
    df = spark.createDataFrame([("ANON-1", "card", dt.date(2024, 5, 3)), (None, "cash", dt.date(2024, 11, 30)),
                                (None, None, dt.date(2025, 1, 1))], "card string, cash_type string, d date")
    got = df.select(customer_key(), period_key(F.col("d"), "month"), period_key(F.col("d"), "quarter")).collect()
    assert [tuple(r) for r in got] == [("ANON-1", "2024-05", "2024-Q2"), ("CASH_cash", "2024-11", "2024-Q4"),
                                       (None, "2025-01", "2025-Q1")]


def test_scale_conf():
    from tillroll.session import scale_conf
    big = scale_conf(100 * 10**12, cores=8000)
    assert big["spark.sql.shuffle.partitions"] == "93133"
    assert big["spark.sql.files.maxPartitionBytes"] == str(256 << 20)
    assert scale_conf(10**6, cores=8)["spark.sql.shuffle.partitions"] == "16"
    assert scale_conf(10**17, cores=8)["spark.sql.shuffle.partitions"] == "100000"
    assert scale_conf(10**15, cores=8, most_partitions=10**7)["spark.sql.shuffle.partitions"] == "931323"


def test_timestamp_text_whole_seconds(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00.12' AS n, timestamp'2024-03-10 02:30:00.12' AS i")
    r = df.select(timestamp_text(F.col("n"), True, 0), timestamp_text(F.col("i"), False, 0)).collect()[0]
    assert r[0] == "2024-03-10 02:30:00" and r[1] == "2024-03-10 02:30:00"


def test_checkpoint_root_is_named_by_the_caller(spark, tmp_path, monkeypatch):
    from tillroll import session
    monkeypatch.setattr(session, "CHECKPOINT_CONF", "spark.a.setting.that.is.unset")
    monkeypatch.setattr(session, "_SCRATCH", {})
    assert not session.has_root(spark)
    with pytest.raises(ValueError, match="shared folder"):
        session.checkpoint_root(spark)
    session.use_scratch(spark, str(tmp_path))
    assert session.has_root(spark) and session.checkpoint_root(spark) == str(tmp_path)
    monkeypatch.undo()
    session.checkpoint_root(spark)
