"""Warehouse reports: V1 performance, V5 shipping/receiving, M1 daily summary,
M6 daily shipping/receiving.

Shape of every plan here: aggregate the big child table to one row per
(warehouse[, day]) with partial aggregation, then join the (small) warehouse
dimension to the aggregate.  The dimension join is left to the planner: it
becomes a broadcast hash join only when the side's size is known to be under
``spark.sql.autoBroadcastJoinThreshold`` (statically or by AQE at runtime).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.exprs import (BIG, avg_hours2, bucket, bucket_end, bucket_start, cents, in_bucket, micros_between, pct, round2,
                               ts_lit)
from ..operators.joins import restrict_to_keys
from ..operators.rollups import attach, child_rollup
from ..sources.monthly import in_months
from ..sources.tables import Tables

LOC_COUNTS = [f"{t}_locations" for t in R.LOCATION_TYPES]


def location_rollup(locations: DataFrame) -> DataFrame:
    """Per warehouse: location counts (location_id is the key of locations),
    utilisation parts and capacity sums."""
    lid, ltype = F.col("location_id"), F.col("location_type")
    return locations.groupBy("warehouse_id").agg(
        F.count(lid).alias("total_locations"),
        *[F.count(F.when(ltype == t, lid)).alias(f"{t}_locations") for t in R.LOCATION_TYPES],
        F.sum(cents(F.col("utilization_rate"))).alias("util_cents"),
        F.count("utilization_rate").alias("util_n"),
        F.sum("available_capacity").alias("sum_available"),
        F.sum("used_capacity").alias("sum_used"),
    )


def _location_measures(factor: Column | None = None) -> list[Column]:
    f = (lambda c: (c.cast(BIG) * factor).cast(BIG)) if factor is not None else (lambda c: c)
    return ([F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ["total_locations"] + LOC_COUNTS]
            + [round2(F.col("util_cents"), F.col("util_n")).alias("avg_utilization_rate"),
               f(F.col("sum_available")).alias("total_available_capacity"),
               f(F.col("sum_used")).alias("total_used_capacity"),
               pct(F.col("sum_used"), F.col("sum_available")).alias("overall_utilization_percent")])


def warehouse_performance(t: Tables) -> DataFrame:
    """V1: one row per warehouse with location counts and capacity use."""
    w = t["warehouses"].select("warehouse_id", "warehouse_name", "location_code")
    j = w.join(location_rollup(t["locations"]), "warehouse_id", "left")
    return j.select("warehouse_id", "warehouse_name", "location_code", *_location_measures())


def _day_counts(df: DataFrame, id_col: str, ts_col: str, as_of: dt.date, name: str) -> DataFrame:
    """Per warehouse: rows and (key) count of ``df`` whose ``ts_col`` falls on as_of."""
    return (df.where(in_bucket(F.col(ts_col), "day", as_of))
              .groupBy("warehouse_id")
              .agg(F.count(F.lit(1)).alias(f"n_{name}"), F.count(id_col).alias(f"total_{name}_today")))


def daily_warehouse_summary(t: Tables, as_of: dt.date, mode: str = "reference") -> DataFrame:
    """M1: V1 plus the day's order/shipment/receipt counts.

    ``mode="reference"`` reproduces the SQL's join fan-out: each warehouse row
    is repeated max(1,#orders)*max(1,#shipments)*max(1,#receipts) times, which
    multiplies the two capacity sums (counts, average and percent are not
    affected).  ``mode="corrected"`` reports the plain sums.
    """
    if mode not in ("reference", "corrected"):
        raise ValueError(mode)
    w = t["warehouses"].select("warehouse_id", "warehouse_name", "location_code")
    j = w.join(location_rollup(t["locations"]), "warehouse_id", "left")
    for name, df, id_col, ts_col in [("orders", t["orders"], "order_id", "order_date"),
                                     ("shipments", t["shipments"], "shipment_id", "ship_date"),
                                     ("receipts", t["receipts"], "receipt_id", "receive_date")]:
        j = j.join(_day_counts(df, id_col, ts_col, as_of, name), "warehouse_id", "left")
    if mode == "reference":
        factor = F.lit(1).cast(BIG)  # the product of three counts outgrows a long
        for n in ("n_orders", "n_shipments", "n_receipts"):
            factor = (factor * F.coalesce(F.col(n), F.lit(1)).cast(BIG)).cast(BIG)
    else:
        factor = F.lit(1).cast(BIG)
    return j.select(
        ts_lit(as_of).alias("summary_date"), "warehouse_id", "warehouse_name", "location_code",
        *_location_measures(factor),
        *[F.coalesce(F.col(f"total_{n}_today"), F.lit(0)).alias(f"total_{n}_today")
          for n in ("orders", "shipments", "receipts")])


# --- shipping / receiving ----------------------------------------------------

SIDES = {
    # activity: (header table, key, event ts, items table, item qty, done status)
    "Shipping": ("shipments", "shipment_id", "ship_date", "shipment_items", "quantity_shipped", R.SHIPMENT_DONE),
    "Receiving": ("receipts", "receipt_id", "receive_date", "receipt_items", "quantity_received", R.RECEIPT_DONE),
}


def activity_rollup(t: Tables, activity: str, header_filter: Column | None = None,
                    restrict: bool = False, period: tuple[dt.datetime, dt.datetime] | None = None) -> DataFrame:
    """One row per shipment (receipt) with its item count/quantity and duration.

    ``restrict=True`` (for a selective header filter, e.g. one day) prunes the
    lines to the filtered headers first, so only their lines are aggregated.
    ``period``: the time the filter lies in, for a layout by month."""
    head, key, ts, items, qty, _ = SIDES[activity]
    h = t[head] if period is None else in_months(t[head], *period)
    if header_filter is not None:
        h = h.where(header_filter)
    lines = restrict_to_keys(t[items], h, key) if restrict else t[items]
    roll = child_rollup(lines, key, {"qty": F.sum(qty)})
    return (attach(h, roll, key)
            .withColumn("dur_us", micros_between(F.col("created_date"), F.col(ts))))


def _activity_measures(key: str, done: str) -> list[Column]:
    dur, w = F.col("dur_us"), F.col("w")
    return [F.count(key).alias("n_ids"), F.sum("qty").alias("qty"),
            F.sum(dur.cast("decimal(38,0)") * w).alias("h_sum"), F.sum(F.when(dur.isNotNull(), w)).alias("h_n"),
            F.count(F.when(F.col("status") == done, F.col(key))).alias("n_done"),
            F.count(F.when(F.col("status") == R.OPEN, F.col(key))).alias("n_open")]


def shipping_receiving_performance(t: Tables) -> DataFrame:
    """V5: per day and warehouse, shipments and receipts (UNION ALL of two branches).

    The shipping branch groups by the ship day (its GROUP BY key); rows with a
    NULL event date are excluded, which also makes the warehouse join inner.
    """
    w = t["warehouses"].select("warehouse_id", "warehouse_name")
    branches = []
    for activity in ("Shipping", "Receiving"):
        head, key, ts, _, _, done = SIDES[activity]
        per = activity_rollup(t, activity, F.col(ts).isNotNull())
        g = per.groupBy(bucket(F.col(ts), "day").alias("activity_date"), "warehouse_id").agg(
            *_activity_measures(key, done))
        branches.append(g.join(w, "warehouse_id", "inner").select(
            "activity_date", "warehouse_id", "warehouse_name", F.lit(activity).alias("activity_type"),
            F.col("n_ids").alias("total_shipments"), F.col("qty").alias("total_quantity_shipped"),
            avg_hours2(F.col("h_sum"), F.col("h_n")).alias("avg_hours_to_ship"),
            F.col("n_done").alias("completed_shipments")))
    return branches[0].unionByName(branches[1])


def daily_shipping_receiving(t: Tables, as_of: dt.date) -> DataFrame:
    """M6: every warehouse twice (Shipping, Receiving) with the day's activity."""
    w = t["warehouses"].select("warehouse_id", "warehouse_name")
    branches = []
    for activity in ("Shipping", "Receiving"):
        head, key, ts, _, _, done = SIDES[activity]
        per = activity_rollup(t, activity, in_bucket(F.col(ts), "day", as_of), restrict=True,
                              period=(bucket_start(as_of, "day"), bucket_end(as_of, "day")))
        g = per.groupBy("warehouse_id").agg(*_activity_measures(key, done))
        j = w.join(g, "warehouse_id", "left")
        n = F.coalesce(F.col("n_ids"), F.lit(0))
        done_n = F.coalesce(F.col("n_done"), F.lit(0))
        branches.append(j.select(
            F.lit(as_of).alias("summary_date"), "warehouse_id", "warehouse_name",
            F.lit(activity).alias("activity_type"),
            n.alias("total_shipments"), F.col("qty").alias("total_quantity_shipped"),
            avg_hours2(F.col("h_sum"), F.col("h_n")).alias("avg_hours_to_ship"),
            done_n.alias("completed_shipments"),
            F.coalesce(F.col("n_open"), F.lit(0)).alias("pending_shipments"),
            pct(done_n, n).alias("shipping_completion_rate")))
    return branches[0].unionByName(branches[1])
