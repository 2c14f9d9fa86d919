"""Monthly layout: headers partitioned by the month of their event, lines by
the month of their header.

A report over a week or a month reads the partitions of its headers by a static
filter (``in_months``).  Its lines have no date; they are joined to the headers
on the parent id and the month, so Spark prunes their partitions at run time by
the months that the filtered headers turn out to have (dynamic partition
pruning), and inside these a run-time Bloom filter of the header ids drops lines
before they are shuffled.  ``session.SCALE_DEFAULTS`` allows both where headers
are too large to be broadcast.

Lines whose header has no event date, or that have no header, are in the
partition of the NULL month, which no dated report reads.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import SCHEMAS, conform

MONTH = "event_month"
#: header: (key, event time, lines)
HEADERS = {"orders": ("order_id", "order_date", "order_items"), "shipments": ("shipment_id", "ship_date", "shipment_items"),
           "receipts": ("receipt_id", "receive_date", "receipt_items")}


def month_of(ts: Column) -> Column:
    """yyyymm as an int."""
    return (F.year(ts) * 100 + F.month(ts)).cast("int")


def write_monthly(tables: Mapping[str, DataFrame], root: str, partitions: int | None = None, names: list[str] | None = None) -> None:
    """Write all twelve tables (or ``names``) below ``root``.  ``partitions``: files written at
    once per table (default: the session's shuffle partitions); a large month
    becomes several files."""
    def stored(df: DataFrame, name: str) -> None:
        n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        # the hash divides a month, and the rows of a hot parent, among tasks
        spread = df.withColumn("_spread", F.xxhash64(*df.columns)).repartitionByRange(n, MONTH, "_spread").drop("_spread")
        spread.write.partitionBy(MONTH).parquet(os.path.join(root, name))

    with_lines, names = {}, names or list(SCHEMAS)
    for name, (key, ts, lines) in HEADERS.items():
        if name not in names:
            continue
        header = conform(tables[name], name).withColumn(MONTH, month_of(F.col(ts)))
        stored(header, name)
        if lines not in names:
            continue
        with_lines[lines] = conform(tables[lines], lines).join(header.select(key, MONTH), key, "left").select(*SCHEMAS[lines].names, MONTH)
    for name, df in with_lines.items():
        stored(df, name)
    for name in SCHEMAS:
        if name in names and name not in HEADERS and name not in with_lines:
            conform(tables[name], name).write.parquet(os.path.join(root, name))


def load_monthly(spark: SparkSession, root: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables (or ``names``) below ``root``; headers and lines have the column ``event_month``."""
    dated = {*HEADERS, *(lines for _, _, lines in HEADERS.values())}
    out = {}
    for name in names or list(SCHEMAS):
        schema = SCHEMAS[name]
        month = [T.StructField(MONTH, T.IntegerType())] if name in dated else []
        out[name] = spark.read.schema(T.StructType([*schema.fields, *month])).parquet(os.path.join(root, name))
    return out


def in_months(df: DataFrame, first: dt.datetime, until: dt.datetime | None = None) -> DataFrame:
    """The months of ``df`` that can hold events in [first, until); all of it in another layout."""
    if MONTH not in df.columns:
        return df
    df = df.where(F.col(MONTH) >= first.year * 100 + first.month)
    if until is None:
        return df
    last = until - dt.timedelta(microseconds=1)
    return df.where(F.col(MONTH) <= last.year * 100 + last.month)
