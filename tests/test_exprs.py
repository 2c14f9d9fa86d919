"""Exact rounding, durations, buckets, LSN and size formatting."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from depotlens.functions import exprs as X


@pytest.mark.parametrize("num,den,expected", [
    (201, 2, 1.01), (-5, 2, -0.03), (5, 2, 0.03), (1, 3, 0.0), (2, 3, 0.01), (100, 1, 1.0),
    (0, 7, 0.0), (-201, 2, -1.01), (201, -2, -1.01), (7, 0, None),
])
def test_round2_half_away(spark, num, den, expected):
    df = spark.createDataFrame([(num, den)], "n long, d long")
    assert df.select(X.round2(F.col("n"), F.col("d"))).first()[0] == expected


def test_pct_and_hours(spark):
    df = spark.createDataFrame([(1, 3, 5_400_000_000, 1)], "a long, b long, us long, n long")
    r = df.select(X.pct(F.col("a"), F.col("b")), X.avg_hours2(F.col("us"), F.col("n"))).first()
    assert r[0] == 33.33 and r[1] == 1.5


def test_whole_days_truncate_toward_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2001, 6, 1, 5),), (dt.datetime(2001, 7, 3, 5),)], "ts timestamp_ntz")
    got = [r[0] for r in df.select(X.whole_days_between(F.col("ts"), dt.date(2001, 7, 1))).collect()]
    assert got == [29, -2]


def test_buckets_and_dow(spark):
    sunday = dt.datetime(2001, 7, 1, 3)
    df = spark.createDataFrame([(sunday,)], "ts timestamp_ntz")
    r = df.select(X.bucket(F.col("ts"), "week"), X.bucket(F.col("ts"), "month"), X.dow0(F.col("ts")),
                  X.in_bucket(F.col("ts"), "week", dt.date(2001, 6, 25))).first()
    assert r[0] == dt.datetime(2001, 6, 25) and r[1] == dt.datetime(2001, 7, 1) and r[2] == 0 and r[3]
    assert X.bucket_end(dt.date(2001, 12, 31), "month") == dt.datetime(2002, 1, 1)
    assert X.minus(dt.date(2001, 3, 31), months=1) == dt.datetime(2001, 2, 28)


def test_lsn_to_long(spark):
    df = spark.createDataFrame([("0/0",), ("0/FFFFFFFF",), ("1/0",), ("16/B374D848",)], "l string")
    got = [int(r[0]) for r in df.select(X.lsn_to_long(F.col("l"))).collect()]
    assert got == [0, 4294967295, 4294967296, 97500059720]


@pytest.mark.parametrize("n,text", [
    (0, "0 bytes"), (10239, "10239 bytes"), (10240, "10 kB"), (10751, "10 kB"), (10752, "11 kB"),
    (20 * 1024 * 1024 - 1, "20 MB"), (10485247, "10239 kB"), (10485248, "10 MB"), (20 * 1024 * 1024, "20 MB"), (5 * 1024 ** 3, "5120 MB"),
    (30 * 1024 ** 3, "30 GB"), (40 * 1024 ** 4, "40 TB"),
])
def test_size_pretty(spark, n, text):
    df = spark.createDataFrame([(n,)], "n long")
    assert df.select(X.size_pretty(F.col("n"))).first()[0] == text
