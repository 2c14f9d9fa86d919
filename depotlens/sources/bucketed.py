"""Co-bucketed layout: headers and their lines clustered on the parent id.

Orders and order lines, shipments and shipment lines, receipts and receipt lines
are written as bucketed tables with the same number of buckets, sorted on the
parent id.  A roll-up of lines per parent and its join to the header then need
no exchange and no sort: each task reads the same bucket of both.  The cost is
paid once, when the tables are written.

Lines without a parent match no header in any report; they would all share one
bucket, so they are kept in a table of their own (``<name>_orphans``), not
bucketed.  A parent's lines are in one bucket by the meaning of the layout: where
a single parent holds more than a task can take, use ``tables.write_tables``,
whose joins are shuffled and can be split.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import SCHEMAS, conform

PARENT = {"orders": "order_id", "order_items": "order_id", "shipments": "shipment_id", "shipment_items": "shipment_id",
          "receipts": "receipt_id", "receipt_items": "receipt_id"}
LINES = ("order_items", "shipment_items", "receipt_items")
BUCKET_BYTES = 16 << 20


def buckets_for(input_bytes: int, least: int = 16) -> int:
    """Buckets for headers and lines of ``input_bytes`` (compressed): a task
    sorts a bucket, so with a fixed number its memory would grow with the input."""
    return max(least, -(-input_bytes // BUCKET_BYTES))


def write_bucketed(tables: Mapping[str, DataFrame], root: str, prefix: str, buckets: int, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Write ``names`` (default: all twelve) below ``root`` and register them as
    ``<prefix><name>``; returns the registered tables."""
    spark = None
    for name in names or list(SCHEMAS):
        df = conform(tables[name], name)
        spark, path, key = df.sparkSession, os.path.join(root, name), PARENT.get(name)
        if key is None:
            df.write.parquet(path)
            continue
        if name in LINES:
            df.where(F.col(key).isNull()).write.parquet(f"{path}_orphans")
            df = df.where(F.col(key).isNotNull())
        # rows reach the task that writes their bucket: one file a bucket
        (df.repartition(buckets, key).write.option("path", path).bucketBy(buckets, key).sortBy(key)
         .format("parquet").saveAsTable(f"{prefix}{name}"))
    return load_bucketed(spark, root, prefix, buckets, names)


def load_bucketed(spark: SparkSession, root: str, prefix: str, buckets: int, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables below ``root``; bucketed ones are registered if the catalogue
    does not know them (a session's own catalogue forgets)."""
    out = {}
    for name in names or list(SCHEMAS):
        path, key = os.path.join(root, name), PARENT.get(name)
        if key is None:
            out[name] = spark.read.schema(SCHEMAS[name]).parquet(path)
            continue
        cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS[name].fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({cols}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
                  f"INTO {int(buckets)} BUCKETS LOCATION '{path}'")
        out[name] = spark.table(f"{prefix}{name}")
    return out


def orphans(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The lines of ``name`` without a parent."""
    return spark.read.schema(SCHEMAS[name]).parquet(os.path.join(root, f"{name}_orphans"))
