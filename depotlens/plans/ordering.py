"""Report ORDER BY clauses with the source dialect's NULL placement.

In the reports' dialect NULLs sort as the largest value: ASC puts them last,
DESC first.  Spark's defaults are the reverse, so every key spells its NULL
order.  Sorting is an optional final step (a range-partitioned global sort);
the driver-side hash check does not need it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..session import checkpoint_root


def asc(c: str) -> Column:
    return F.col(c).asc_nulls_last()


def desc(c: str) -> Column:
    return F.col(c).desc_nulls_first()


def _day_index() -> Column:
    """day_of_week (Sunday = 0) recovered from day_name, to sort Q4 by a column
    the report does not select."""
    out = None
    for conds, label in R.DAY_NAME.rules:
        idx = conds[0][2]
        out = F.when(F.col("day_name") == label, F.lit(idx)) if out is None else \
            out.when(F.col("day_name") == label, F.lit(idx))
    return out.otherwise(F.lit(6)).asc_nulls_last()


ORDER: dict[str, list] = {
    "v3_order_performance": [lambda: desc("order_date"), lambda: asc("warehouse_id")],
    "v4_customer_insights": [lambda: desc("total_spent")],
    "v5_shipping_receiving_performance": [lambda: desc("activity_date"), lambda: asc("warehouse_id"),
                                          lambda: asc("activity_type")],
    "v6_product_movement_summary": [lambda: desc("movement_date"), lambda: asc("product_id")],
    "q1_warehouse_monthly_ranking": [lambda: desc("month"), lambda: asc("revenue_rank")],
    "q2_inventory_forecast": [lambda: desc("week"), lambda: desc("reorder_priority"),
                              lambda: desc("forecast_next_week")],
    "q3_customer_rfm": [lambda: desc("rfm_score"), lambda: desc("total_spent")],
    "q4_hourly_operations": [lambda: asc("warehouse_name"), _day_index, lambda: asc("hour_of_day")],
    "q5_supply_chain": [lambda: desc("receive_date"), lambda: asc("warehouse_name")],
}


def ordered(name: str, df: DataFrame) -> DataFrame:
    """Apply the report's ORDER BY (no-op for reports without one)."""
    keys = ORDER.get(name)
    return df.orderBy(*[k() for k in keys]) if keys else df


def with_position(df: DataFrame, keys: list[Column], name: str = "position") -> DataFrame:
    """``df`` with every row's place (from 1) in the order of ``keys``.

    A ``row_number`` over the whole result would bring all rows to one task.
    Here the rows are range-partitioned and sorted, which is a global order
    already; the sorted rows are written with their partition and their place
    in it, and the sizes of the partitions before give the offset.  The sizes
    are one number a partition, all that reaches the driver.
    """
    spark = df.sparkSession
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within the partition
    path = checkpoint_root(spark, "positions", uuid.uuid4().hex)
    df.orderBy(*keys).select("*", F.spark_partition_id().alias("_part"), place.alias("_place")).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}
    offsets, at = [], 0
    for part in sorted(sizes):
        offsets.append((part, at))
        at += sizes[part]
    before = spark.createDataFrame(offsets, "_part int, _before long")
    return (rows.join(F.broadcast(before), "_part")
            .select(*df.columns, (F.col("_before") + F.col("_place") + 1).alias(name)))


def positions(name: str, df: DataFrame) -> DataFrame:
    """A report with the place of every row in its ORDER BY; ties are broken by
    the other columns by name, NULLs last, so that places are defined."""
    return with_position(df, [k() for k in ORDER[name]] + [asc(c) for c in sorted(df.columns)])
