"""Primitive operators of the reports, one registered key each.

Every key runs one relational building block of the reports over the whole
fixture tables so it can be checked on its own: join edges (J4, J7, J8, J12+13,
J14, J15, J16), aggregate forms (A1, A2, A6, A8, A10, line weighting), windows
(W1-W5), date arithmetic, UNION ALL, the disjunctive and BETWEEN filters and
an uncorrelated scalar subquery.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.exprs import (BIG, avg_hours2, bucket, dow0, in_bucket, micros_between, minus,
                               money_from_cents, pct, round2, since, ts_lit, whole_days_between)
from ..functions.rules import ladder
from ..operators.joins import left_join_many
from ..operators.rollups import order_rollup, weighted_hours_aggs
from ..sources.fixtures import AS_OF, fixture_tables
from ..sources.tables import Tables
from .inventory import _type_qty, movements_with_warehouse


def j_left_dim(t: Tables) -> DataFrame:
    """Every order with its warehouse name (NULL when unmatched)."""
    w = t["warehouses"].select("warehouse_id", "warehouse_name")
    return t["orders"].select("order_id", "warehouse_id").join(w, "warehouse_id", "left")


def j_left_residual_eq(t: Tables, as_of: dt.date) -> DataFrame:
    """Warehouses LEFT JOIN orders ON key AND day(order_date) = day(as_of).

    The residual is a predicate on the right side only, so it is applied
    before the join (as a pushed range filter) and the join stays an equi-join.
    """
    o = t["orders"].where(in_bucket(F.col("order_date"), "day", as_of)).select("warehouse_id", "order_id")
    return left_join_many(t["warehouses"].select("warehouse_id", "warehouse_name"), o, "warehouse_id")


def j_left_residual_range(t: Tables, as_of: dt.date) -> DataFrame:
    """Products LEFT JOIN movements ON key AND movement_date >= as_of - 30 days."""
    m = (t["inventory_movements"].where(since(F.col("movement_date"), as_of, days=30))
         .select("product_id", "movement_id", "movement_date"))
    return left_join_many(t["products"].select("product_id"), m, "product_id")


def j_double_lookup_coalesce(t: Tables) -> DataFrame:
    """J12+J13: movement -> from/to location -> warehouse of COALESCE(from, to)."""
    m = t["inventory_movements"].select("movement_id", "from_location_id", "to_location_id")
    return movements_with_warehouse(t, m).select("movement_id", "from_location_id", "to_location_id",
                                                 "warehouse_id", "warehouse_name")


def j_outer_to_inner(t: Tables, as_of: dt.date) -> DataFrame:
    """Warehouses LEFT JOIN orders LEFT JOIN items WHERE order_date >= as_of - 12 months.

    The WHERE rejects NULL order rows, so the first outer join is inner
    (Catalyst's EliminateOuterJoin does this; written inner here directly).
    """
    o = t["orders"].where(since(F.col("order_date"), as_of, months=12)).select("order_id", "warehouse_id")
    w = t["warehouses"].select("warehouse_id")
    items = t["order_items"].select("order_id", "order_item_id")
    return left_join_many(o.join(w, "warehouse_id", "inner"), items, "order_id").select("warehouse_id", "order_id", "order_item_id")


def j_inner_star(t: Tables, as_of: dt.date) -> DataFrame:
    """Orders JOIN items JOIN warehouses over the last 30 days."""
    o = t["orders"].where(since(F.col("order_date"), as_of, days=30)).select("order_id", "warehouse_id")
    items = t["order_items"].select("order_id", "order_item_id")
    w = t["warehouses"].select("warehouse_id", "warehouse_name")
    return o.join(items, "order_id").join(w, "warehouse_id").select("order_id", "order_item_id", "warehouse_name")


def j_fanout_product(t: Tables, as_of: dt.date) -> DataFrame:
    """Rows the naive warehouse x locations x day's orders x shipments x
    receipts join would produce, per warehouse, computed from per-child counts
    (product of max(1, n)) without materialising the product."""
    def n_day(df, ts, name):
        return (df.where(in_bucket(F.col(ts), "day", as_of)).groupBy("warehouse_id")
                .agg(F.count(F.lit(1)).alias(name)))
    j = (t["warehouses"].select("warehouse_id")
         .join(t["locations"].groupBy("warehouse_id").agg(F.count(F.lit(1)).alias("n_locations")),
               "warehouse_id", "left")
         .join(n_day(t["orders"], "order_date", "n_orders"), "warehouse_id", "left")
         .join(n_day(t["shipments"], "ship_date", "n_shipments"), "warehouse_id", "left")
         .join(n_day(t["receipts"], "receive_date", "n_receipts"), "warehouse_id", "left"))
    names = ["n_locations", "n_orders", "n_shipments", "n_receipts"]
    rows = F.lit(1).cast(BIG)
    for n in names:
        rows = (rows * F.coalesce(F.col(n), F.lit(1)).cast(BIG)).cast(BIG)
    return j.select("warehouse_id", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names],
                    rows.alias("joined_rows"))


def agg_count_distinct(t: Tables) -> DataFrame:
    """A1: distinct customers and distinct products ordered, per warehouse."""
    o = t["orders"].select("order_id", "warehouse_id", "customer_id")
    cust = o.groupBy("warehouse_id").agg(F.count_distinct("customer_id").alias("distinct_customers"))
    prod = (t["order_items"].select("order_id", "product_id").join(o, "order_id")
            .groupBy("warehouse_id").agg(F.count_distinct("product_id").alias("distinct_products")))
    # NULL warehouse is a group of its own: null-safe key match
    j = cust.join(prod, cust.warehouse_id.eqNullSafe(prod.warehouse_id), "left")
    return j.select(cust.warehouse_id, "distinct_customers",
                    F.coalesce("distinct_products", F.lit(0)).alias("distinct_products"))


def agg_cond_distinct(t: Tables) -> DataFrame:
    """A2: COUNT(DISTINCT CASE WHEN status = s THEN customer_id END) per warehouse
    and status, as dedup (warehouse, status, customer) + conditional counts:
    two partial-aggregated shuffles instead of one Expand per status."""
    d = t["orders"].select("warehouse_id", "status", "customer_id").distinct()
    st = F.col("status")
    return d.groupBy("warehouse_id").agg(
        *[F.count(F.when(st == s, F.col("customer_id"))).alias(f"{s}_customers")
          for s in (R.ORDER_COMPLETED, R.ORDER_PENDING, R.ORDER_CANCELLED)])


def agg_cond_sum(t: Tables) -> DataFrame:
    """SUM(CASE WHEN type = x THEN qty ELSE 0 END) per product, all history."""
    return t["inventory_movements"].groupBy("product_id").agg(
        F.sum(_type_qty(R.MOVE_IN)).alias("quantity_in"), F.sum(_type_qty(R.MOVE_OUT)).alias("quantity_out"),
        F.sum(_type_qty(R.MOVE_TRANSFER)).alias("quantity_transfer"))


def agg_avg_duration(t: Tables) -> DataFrame:
    """Per warehouse, ROUND(AVG(hours from order to ship), 2) over orders."""
    us = micros_between(F.col("order_date"), F.col("ship_date"))
    return t["orders"].groupBy("warehouse_id").agg(
        avg_hours2(F.sum(us.cast(BIG)), F.count(us)).alias("avg_hours_to_ship"))


def agg_ratio_percent(t: Tables) -> DataFrame:
    """A10: per warehouse, shipped / ordered quantity in percent (NULLIF guard)."""
    per = order_rollup(t["orders"], t["order_items"])
    return per.groupBy("warehouse_id").agg(F.sum("sum_shipped").alias("s"), F.sum("sum_ordered").alias("o")) \
              .select("warehouse_id", pct(F.col("s"), F.col("o")).alias("fulfillment_rate_percent"))


def agg_weighted_line_avg(t: Tables) -> DataFrame:
    """Per warehouse, AVG(hours to ship) over orders LEFT JOIN items rows:
    each order weighs max(1, #lines)."""
    per = order_rollup(t["orders"], t["order_items"])
    return per.groupBy("warehouse_id").agg(*weighted_hours_aggs()) \
              .select("warehouse_id", avg_hours2(F.col("h_sum"), F.col("h_n")).alias("avg_hours_to_ship"))


def _monthly_revenue(t: Tables) -> DataFrame:
    per = order_rollup(t["orders"], t["order_items"])
    return per.groupBy(bucket(F.col("order_date"), "month").alias("month"), "warehouse_id").agg(
        F.sum("value_cents").alias("rev_cents"))


def w_row_number_rank(t: Tables) -> DataFrame:
    """ROW_NUMBER per month by revenue DESC (NULLs first), ties by warehouse."""
    m = _monthly_revenue(t)
    w = Window.partitionBy("month").orderBy(F.col("rev_cents").desc_nulls_first(), F.col("warehouse_id"))
    return m.select("month", "warehouse_id", money_from_cents(F.col("rev_cents")).alias("total_revenue"),
                    F.row_number().over(w).cast("long").alias("revenue_rank"))


def _weekly_out(t: Tables) -> DataFrame:
    return t["inventory_movements"].groupBy("product_id", bucket(F.col("movement_date"), "week").alias("week")) \
        .agg(F.sum(_type_qty(R.MOVE_OUT)).alias("quantity_out"))


def w_moving_avg_4(t: Tables) -> DataFrame:
    """Per product, 4-row moving average of the weekly outflow (all weeks)."""
    frame = Window.partitionBy("product_id").orderBy("week").rowsBetween(-3, Window.currentRow)
    s = _weekly_out(t).select("product_id", "week", "quantity_out",
                              F.sum("quantity_out").over(frame).alias("_s"),
                              F.count("quantity_out").over(frame).alias("_n"))
    return s.select("product_id", "week", "quantity_out",
                    round2(F.col("_s").cast(BIG) * 100, F.col("_n")).alias("avg_weekly_consumption"))


def w_lag_delta(t: Tables) -> DataFrame:
    """Per product, weekly outflow minus the previous week row's outflow."""
    by = Window.partitionBy("product_id").orderBy("week")
    return _weekly_out(t).select("product_id", "week", "quantity_out",
                                 (F.col("quantity_out") - F.lag("quantity_out", 1).over(by))
                                 .alias("consumption_trend"))


def s_date_arith(t: Tables, as_of: dt.date) -> DataFrame:
    """Buckets, hour, Sunday-0 weekday, hours to ship, whole days to as_of."""
    o = t["orders"]
    od = F.col("order_date")
    us = micros_between(od, F.col("ship_date"))
    return o.select(
        "order_id", bucket(od, "day").alias("order_day"), bucket(od, "week").alias("order_week"),
        bucket(od, "month").alias("order_month"), F.hour(od).cast("long").alias("hour_of_day"),
        dow0(od).cast("long").alias("day_of_week"),
        round2(us.cast(BIG), F.when(us.isNotNull(), F.lit(36_000_000))).alias("hours_to_ship"),
        whole_days_between(od, as_of).alias("days_before_as_of"),
        (od >= ts_lit(minus(as_of, days=30))).alias("in_last_30_days"))


def u_union_all_branches(t: Tables) -> DataFrame:
    """UNION ALL by position; names come from the first branch."""
    s = t["shipments"].select(F.col("shipment_id").alias("activity_id"), "warehouse_id",
                              bucket(F.col("ship_date"), "day").alias("activity_date"),
                              F.lit(R.ACTIVITY_SHIPPING).alias("activity_type"))
    r = t["receipts"].select("receipt_id", "warehouse_id", bucket(F.col("receive_date"), "day"),
                             F.lit(R.ACTIVITY_RECEIVING))
    return s.union(r)


def f_disjunctive_range(t: Tables, as_of: dt.date) -> DataFrame:
    """orders with order_date >= c OR ship_date >= c (NULL OR TRUE keeps)."""
    c = ts_lit(minus(as_of, days=30))
    return t["orders"].where((F.col("order_date") >= c) | (F.col("ship_date") >= c)) \
                      .select("order_id", "order_date", "ship_date")


def f_between_first_match(t: Tables) -> DataFrame:
    """overlapping inclusive BETWEEN ranges, first match wins (hour labels)."""
    h = F.hour("order_date").cast("long")
    return t["orders"].select("order_id", h.alias("hour_of_day"),
                              ladder(R.TIME_PERIOD, {"hour": h}).alias("time_period"))


def p_scalar_subquery(t: Tables) -> DataFrame:
    """F8: per warehouse share of all orders, total from an uncorrelated scalar
    subquery (evaluated once, no join)."""
    o = t["orders"]
    total = o.select(F.count(F.lit(1))).scalar()
    g = o.groupBy("warehouse_id").agg(F.count(F.lit(1)).alias("orders"))
    return g.select("warehouse_id", "orders", total.alias("all_orders"),
                    round2(F.col("orders").cast(BIG) * 10000, total).alias("share_percent"))


def _t(fn, *args):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(fixture_tables(spark, sf_dir), *args)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


PRIMITIVES = {
    "j_left_dim": _t(j_left_dim),
    "j_left_residual_eq": _t(j_left_residual_eq, AS_OF),
    "j_left_residual_range": _t(j_left_residual_range, AS_OF),
    "j_double_lookup_coalesce": _t(j_double_lookup_coalesce),
    "j_outer_to_inner": _t(j_outer_to_inner, AS_OF),
    "j_inner_star": _t(j_inner_star, AS_OF),
    "j_fanout_product": _t(j_fanout_product, AS_OF),
    "agg_count_distinct": _t(agg_count_distinct),
    "agg_cond_distinct": _t(agg_cond_distinct),
    "agg_cond_sum": _t(agg_cond_sum),
    "agg_avg_duration": _t(agg_avg_duration),
    "agg_ratio_percent": _t(agg_ratio_percent),
    "agg_weighted_line_avg": _t(agg_weighted_line_avg),
    "w_row_number_rank": _t(w_row_number_rank),
    "w_moving_avg_4": _t(w_moving_avg_4),
    "w_lag_delta": _t(w_lag_delta),
    "s_date_arith": _t(s_date_arith, AS_OF),
    "u_union_all_branches": _t(u_union_all_branches),
    "f_disjunctive_range": _t(f_disjunctive_range, AS_OF),
    "f_between_first_match": _t(f_between_first_match),
    "p_scalar_subquery": _t(p_scalar_subquery),
}
