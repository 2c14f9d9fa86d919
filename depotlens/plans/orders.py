"""Order reports: V3 daily performance, M3 weekly summary, Q1 monthly warehouse
ranking, Q4 hour-of-day operations.

All four start from ``order_rollup``: order_items aggregated to one row per
order (one shuffle on order_id, reduced map-side), joined 1:1 to orders.  The
multi-``COUNT(DISTINCT)`` of the SQL become plain counts over that frame (one
row per order), so no Expand pass is needed; the group-level aggregation then
reduces to (bucket, warehouse) rows before the warehouse dimension is joined.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.exprs import (MICROS_PER_HUNDREDTH_HOUR, avg_hours2, bucket, bucket_end, bucket_start, dow0, in_bucket,
                               minus, money_from_cents, pct, round2, round_half_away, since, ts_lit)
from ..functions.rules import ladder
from ..operators.rollups import order_rollup, weighted_hours_aggs
from ..sources.monthly import in_months
from ..sources.tables import Tables


def _order_group_aggs(distinct_items: bool) -> list[Column]:
    oid, st = F.col("order_id"), F.col("status")
    aggs = [F.count(oid).alias("total_orders")]
    if distinct_items:
        aggs.append(F.coalesce(F.sum("n_items"), F.lit(0)).alias("total_order_items"))
    aggs += [F.sum("sum_ordered").alias("total_quantity_ordered"),
             F.sum("sum_shipped").alias("total_quantity_shipped"),
             F.sum("sum_backordered").alias("total_quantity_backordered"),
             F.sum("price_cents").alias("price_cents"), F.sum("price_n").alias("price_n"),
             F.sum("value_cents").alias("value_cents"), F.sum("n_ordered").alias("n_ordered"),
             *weighted_hours_aggs(),
             F.count(F.when(st == R.ORDER_COMPLETED, oid)).alias("completed_orders"),
             F.count(F.when(st == R.ORDER_PENDING, oid)).alias("pending_orders"),
             F.count(F.when(st == R.ORDER_CANCELLED, oid)).alias("cancelled_orders")]
    return aggs


def _order_measures() -> list[Column]:
    return ["total_orders", "total_order_items", "total_quantity_ordered", "total_quantity_shipped",
            "total_quantity_backordered",
            round2(F.col("price_cents"), F.col("price_n")).alias("avg_unit_price"),
            money_from_cents(F.col("value_cents")).alias("total_order_value"),
            avg_hours2(F.col("h_sum"), F.col("h_n")).alias("avg_hours_to_ship"),
            "completed_orders", "pending_orders", "cancelled_orders",
            pct(F.col("completed_orders"), F.col("total_orders")).alias("completion_rate_percent")]


def order_performance(t: Tables) -> DataFrame:
    """V3: per order day and warehouse (NULL warehouse is its own group)."""
    per = order_rollup(t["orders"], t["order_items"], distinct_items=True)
    g = per.groupBy(bucket(F.col("order_date"), "day").alias("order_date"), "warehouse_id").agg(
        *_order_group_aggs(True))
    return order_figures(g, t["warehouses"])


def order_figures(g: DataFrame, warehouses: DataFrame) -> DataFrame:
    """V3 from its sums per day and warehouse."""
    w = warehouses.select("warehouse_id", "warehouse_name")
    return g.join(w, "warehouse_id", "left").select(
        "order_date", "warehouse_id", "warehouse_name", *_order_measures())


def weekly_order_summary(t: Tables, as_of: dt.date) -> DataFrame:
    """M3: orders of as_of's (Monday) week per warehouse."""
    orders = in_months(t["orders"], bucket_start(as_of, "week"), bucket_end(as_of, "week")).where(in_bucket(F.col("order_date"), "week", as_of))
    per = order_rollup(orders, t["order_items"], distinct_items=True, restrict=True)
    g = per.groupBy("warehouse_id").agg(*_order_group_aggs(True),
                                        F.count_distinct("customer_id").alias("unique_customers"))
    w = t["warehouses"].select("warehouse_id", "warehouse_name")
    return g.join(w, "warehouse_id", "left").select(
        ts_lit(bucket_start(as_of, "week")).alias("summary_week"), "warehouse_id", "warehouse_name",
        *_order_measures(), "unique_customers",
        round2(F.col("total_quantity_ordered").cast("decimal(38,0)") * 100, F.col("n_ordered"))
        .alias("avg_items_per_order"))


def warehouse_monthly_ranking(t: Tables, as_of: dt.date) -> DataFrame:
    """Q1: monthly warehouse stats over the last 12 months, three per-month
    ROW_NUMBER ranks (ties broken by warehouse_id) and a category label.

    The WHERE on the order date turns the warehouse->orders outer joins inner.
    The rank windows partition by month over one row per warehouse.
    """
    orders = in_months(t["orders"], minus(as_of, months=12)).where(since(F.col("order_date"), as_of, months=12))
    per = order_rollup(orders, t["order_items"], restrict=True)
    g = per.groupBy(bucket(F.col("order_date"), "month").alias("month"), "warehouse_id").agg(
        F.count("order_id").alias("total_orders"), F.sum("value_cents").alias("rev_cents"),
        *weighted_hours_aggs(), F.count_distinct("customer_id").alias("unique_customers"),
        F.sum("sum_ordered").alias("q_ord"), F.sum("sum_shipped").alias("q_ship"))
    w = t["warehouses"].select("warehouse_id", "warehouse_name", "region")
    s = g.join(w, "warehouse_id", "inner").select(
        "month", "warehouse_id", "warehouse_name", "region", "total_orders", "rev_cents",
        money_from_cents(F.col("rev_cents")).alias("total_revenue"),
        avg_hours2(F.col("h_sum"), F.col("h_n")).alias("avg_fulfillment_hours"),
        "unique_customers", pct(F.col("q_ship"), F.col("q_ord")).alias("fulfillment_rate_percent"))
    by_month = Window.partitionBy("month")
    tie = F.col("warehouse_id").asc()
    ranks = s.select(
        "*",
        F.row_number().over(by_month.orderBy(F.col("rev_cents").desc_nulls_first(), tie)).cast("long")
        .alias("revenue_rank"),
        F.row_number().over(by_month.orderBy(F.col("avg_fulfillment_hours").asc_nulls_last(), tie)).cast("long")
        .alias("speed_rank"),
        F.row_number().over(by_month.orderBy(F.col("fulfillment_rate_percent").desc_nulls_first(), tie))
        .cast("long").alias("fulfillment_rank"))
    return ranks.select(
        "month", "warehouse_name", "region", "total_orders", "total_revenue", "avg_fulfillment_hours",
        "unique_customers", "fulfillment_rate_percent", "revenue_rank", "speed_rank", "fulfillment_rank",
        ladder(R.PERFORMANCE_CATEGORY, {k: F.col(k) for k in ("revenue_rank", "speed_rank", "fulfillment_rank")})
        .alias("performance_category"))


def hourly_operations(t: Tables, as_of: dt.date) -> DataFrame:
    """Q4: per hour of day, day of week (Sunday = 0) and warehouse over the last
    30 days.  Inner joins: orders without lines or warehouse drop out; the
    fulfillment average is weighted by the line count.  The efficiency score
    divides by the already rounded hours, as the report does."""
    orders = in_months(t["orders"], minus(as_of, days=30)).where(since(F.col("order_date"), as_of, days=30))
    per = order_rollup(orders, t["order_items"], inner=True, restrict=True)
    g = per.groupBy(F.hour("order_date").cast("long").alias("hour_of_day"),
                    dow0(F.col("order_date")).cast("long").alias("day_of_week"), "warehouse_id").agg(
        F.count("order_id").alias("orders_count"), F.sum("sum_ordered").alias("total_quantity_ordered"),
        F.sum("value_cents").alias("value_cents"), F.sum("value_n").alias("value_n"),
        F.count_distinct("customer_id").alias("unique_customers"), *weighted_hours_aggs())
    w = t["warehouses"].select("warehouse_id", "warehouse_name")
    hours_h = round_half_away(F.col("h_sum").cast("decimal(38,0)"),
                              F.col("h_n").cast("decimal(38,0)") * MICROS_PER_HUNDREDTH_HOUR)
    e = g.join(w, "warehouse_id", "inner").select(
        "*", round2(F.col("value_cents"), F.col("value_n")).alias("avg_order_value"),
        (hours_h.cast("double") / 100.0).alias("avg_fulfillment_hours"),
        round2(F.col("orders_count").cast("decimal(38,0)") * 10000, hours_h).alias("efficiency_score"))
    return e.select(
        "warehouse_name",
        ladder(R.DAY_NAME, {"dow": F.col("day_of_week")}).alias("day_name"),
        ladder(R.TIME_PERIOD, {"hour": F.col("hour_of_day")}).alias("time_period"),
        "hour_of_day", "orders_count", "total_quantity_ordered", "avg_order_value", "unique_customers",
        "avg_fulfillment_hours", "efficiency_score",
        ladder(R.EFFICIENCY_LEVEL, {"score": F.col("efficiency_score")}).alias("efficiency_level"),
        ladder(R.STAFFING, {"orders": F.col("orders_count")}).alias("staffing_recommendation"))
