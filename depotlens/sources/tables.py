"""Logical warehouse-operations tables: schemas and loaders.

The reports take a ``Tables`` mapping (table name -> DataFrame).  In
production the twelve base tables are Parquet folders (one per table, ideally
partitioned by month of their event date and sorted by it inside files so that
min/max statistics prune the date-bucket filters); ``load_tables`` reads them
with explicit schemas, so no job is spent on schema inference.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
L, S, TS = T.LongType(), T.StringType(), T.TimestampNTZType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "warehouses": _schema(("warehouse_id", L), ("warehouse_name", S), ("location_code", S), ("region", S)),
    "locations": _schema(("location_id", L), ("warehouse_id", L), ("location_type", S),
                         ("utilization_rate", MONEY), ("available_capacity", L), ("used_capacity", L)),
    "products": _schema(("product_id", L), ("product_name", S), ("product_category", S), ("sku", S),
                        ("unit_of_measure", S)),
    "inventory": _schema(("product_id", L), ("location_id", L), ("quantity_on_hand", L),
                         ("quantity_allocated", L), ("unit_cost", MONEY), ("last_updated", TS)),
    "inventory_movements": _schema(("movement_id", S), ("product_id", L), ("movement_type", S),
                                   ("movement_date", TS), ("quantity_moved", L), ("unit_cost", MONEY),
                                   ("from_location_id", L), ("to_location_id", L)),
    "orders": _schema(("order_id", L), ("customer_id", L), ("warehouse_id", L), ("status", S),
                      ("order_date", TS), ("ship_date", TS)),
    "order_items": _schema(("order_item_id", S), ("order_id", L), ("product_id", L), ("quantity_ordered", L),
                           ("quantity_shipped", L), ("quantity_backordered", L), ("unit_price", MONEY)),
    "customers": _schema(("customer_id", L), ("customer_name", S), ("customer_type", S), ("region", S),
                         ("country", S)),
    "shipments": _schema(("shipment_id", L), ("warehouse_id", L), ("ship_date", TS), ("created_date", TS),
                         ("status", S)),
    "shipment_items": _schema(("shipment_id", L), ("quantity_shipped", L)),
    "receipts": _schema(("receipt_id", L), ("warehouse_id", L), ("receive_date", TS), ("created_date", TS),
                        ("status", S)),
    "receipt_items": _schema(("receipt_id", L), ("quantity_received", L)),
}

# Declared primary keys (inferred from the join edges).  Reports count a key
# column with a plain ``count`` only where the frame holds one row per key of
# a table listed here; ``operators.snapshots.duplicate_keys`` checks them.
PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "warehouses": ("warehouse_id",),
    "locations": ("location_id",),
    "products": ("product_id",),
    "inventory": ("product_id", "location_id"),
    "orders": ("order_id",),
    "customers": ("customer_id",),
    "shipments": ("shipment_id",),
    "receipts": ("receipt_id",),
}

Tables = Mapping[str, DataFrame]


def load_tables(spark: SparkSession, root: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Read ``root/<table>`` Parquet folders with the declared schemas."""
    from ..session import ensure_utc
    ensure_utc(spark)
    out = {}
    for name in names or list(SCHEMAS):
        out[name] = spark.read.schema(SCHEMAS[name]).parquet(os.path.join(root, name))
    return out


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project/cast ``df`` onto the declared schema of ``name`` (column order too)."""
    return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])


# Physical layout of the base tables: the column each table is clustered on.
# Facts with an event time are range-partitioned and sorted by it, so the
# reports' date-bucket filters skip row groups by their min/max statistics;
# line tables are clustered by their parent id, so per-parent partial
# aggregation collapses each parent's lines map-side.
CLUSTER_BY = {
    "orders": "order_date", "inventory_movements": "movement_date", "shipments": "ship_date",
    "receipts": "receive_date", "inventory": "product_id", "order_items": "order_id",
    "shipment_items": "shipment_id", "receipt_items": "receipt_id",
}


def write_tables(tables: Mapping[str, DataFrame], root: str, partitions: int | None = None,
                 mode: str = "errorifexists") -> list[str]:
    """Write the twelve base tables as ``root/<table>`` Parquet folders laid
    out for the reports (see ``CLUSTER_BY``); dimensions are written as is.
    ``partitions`` is the number of files per clustered table (default: the
    session's shuffle partitions)."""
    written = []
    for name in SCHEMAS:
        df = conform(tables[name], name)
        col = CLUSTER_BY.get(name)
        if col:
            n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
            # the hash divides the rows of one value (NULL dates, a hot order) among files
            df = (df.withColumn("_spread", F.xxhash64(*df.columns)).repartitionByRange(n, col, "_spread")
                  .sortWithinPartitions(col).drop("_spread"))
        path = os.path.join(root, name)
        df.write.mode(mode).parquet(path)
        written.append(path)
    return written
