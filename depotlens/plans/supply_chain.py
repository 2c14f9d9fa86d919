"""Q5 supply chain / bottleneck report without the receipts x shipments product.

The report joins each warehouse to all its receipt lines *and* all its
shipment lines, i.e. a per-warehouse cross product whose size grows with the
square of the warehouse's activity, then groups by (receive day, ship day).
Every measure of a (warehouse, receive day, ship day) group factorises into
per-side aggregates:

* counts and averages of one side are that side's own figures (each row of
  one side is repeated once per row of the other side);
* quantity sums are multiplied by the other side's row count;
* the receive->ship processing time averages over both-non-NULL pairs, which
  equals mean(ship ts) - mean(receive ts) of the two groups.

So each side is reduced to one row per (warehouse, day) first and only the
day aggregates are paired.  Per side, the exact mean timestamp is kept as a
floor quotient and remainder of longs (mean = q + r/n, 0 <= r < n); the pair
then needs long arithmetic only: with D = q_b - q_a and s = sign(r_b n_a -
r_a n_b), the rounded hours are round_half_away((2D + s) / 72e6) / 100 --
exact, because every rounding boundary of (mean_b - mean_a) / 36e6 lies on a
whole microsecond while a non-zero fractional part never does.  The WHERE (receive >= c OR ship >= c) with a
midnight-aligned cut-off c is decided by the day alone, and is split into
(recent receive days x all ship days) UNION ALL (other receive days x recent
ship days): every pair produced is an output row, no pair is filtered away.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.exprs import (BIG, MICROS_PER_HUNDREDTH_HOUR, avg_hours2, bucket, hundredths, idiv,
                               micros_between, minus, round2, round_half_away, ts_lit)
from ..functions.rules import ladder
from ..sources.tables import Tables
from .warehouse import SIDES, activity_rollup


def side_days(t: Tables, activity: str, as_of: dt.date, prefix: str, day_name: str) -> DataFrame:
    """warehouses LEFT JOIN header LEFT JOIN items, reduced to (warehouse, day):
    joined-row count, distinct headers, quantity, rounded average duration and
    the exact mean event time (relative to as_of) as long quotient/remainder."""
    head, key, ts, _, _, _ = SIDES[activity]
    per = activity_rollup(t, activity).withColumn("rel_us", micros_between(ts_lit(as_of), F.col(ts)))
    w, dur, rel = F.col("w"), F.col("dur_us"), F.col("rel_us")
    g = per.groupBy("warehouse_id", bucket(F.col(ts), "day").alias(day_name)).agg(
        F.sum(w).alias("rows"), F.count(key).alias("ids"), F.sum("qty").alias("qty"),
        F.sum(dur.cast(BIG) * w).alias("hsum"), F.sum(F.when(dur.isNotNull(), w)).alias("hn"),
        F.sum(rel.cast(BIG) * w).alias("esum"), F.sum(F.when(rel.isNotNull(), w)).alias("en"))
    en = F.nullif(F.col("en"), F.lit(0))
    q0 = idiv(F.col("esum"), en)
    r0 = F.col("esum") - q0 * en
    g = g.select("warehouse_id", day_name, "rows", "ids", "qty",
                 avg_hours2(F.col("hsum"), F.col("hn")).alias("hours"),
                 F.when(r0 < 0, q0 - 1).otherwise(q0).cast("long").alias("q"),
                 F.when(r0 < 0, r0 + en).otherwise(r0).cast("long").alias("r"), en.alias("en"))
    wh = t["warehouses"].select("warehouse_id", "warehouse_name", "region")
    j = wh.join(g, "warehouse_id", "left")
    # a warehouse without any header row still yields one all-NULL joined row
    return j.select("warehouse_id", "warehouse_name", "region", day_name,
                    *[F.col(c).alias(f"{prefix}_{c}") for c in ("qty", "hours", "q", "r", "en")],
                    F.coalesce(F.col("rows"), F.lit(1)).alias(f"{prefix}_rows"),
                    F.coalesce(F.col("ids"), F.lit(0)).alias(f"{prefix}_ids"))


SPLIT = 16  # tasks that share the output of one warehouse


def pair_days(a: DataFrame, b: DataFrame, cut: Column) -> DataFrame:
    """Days of both sides of a warehouse of which at least one is recent.

    One equi-join on (warehouse, group, part).  Group one pairs the recent
    receive days with all ship days, group two the old receive days with the
    recent ship days.  In either the long side is dealt to SPLIT parts by its
    date and the recent days, which are few, are repeated for each part, so a
    warehouse with most of the days is paired by many tasks.
    """
    recent = lambda c: F.coalesce(F.col(c) >= cut, F.lit(False))
    parts = range(SPLIT)
    dealt = lambda c: F.pmod(F.xxhash64(c), F.lit(SPLIT)).cast("int")

    def where(group: int, part: Column) -> Column:
        return F.struct(F.lit(group).alias("_group"), part.alias("_part"))

    every = lambda group: F.array(*[where(group, F.lit(p)) for p in parts])
    left = a.select("*", F.inline(F.when(recent("receive_date"), every(1)).otherwise(F.array(where(2, dealt("receive_date"))))))
    own = F.array(where(1, dealt("ship_date")))
    right = b.select("*", F.inline(F.when(recent("ship_date"), F.concat(own, every(2))).otherwise(own)))
    return left.join(right, ["warehouse_id", "_group", "_part"]).drop("_group", "_part")


def supply_chain(t: Tables, as_of: dt.date, days: int = 30, mode: str = "reference") -> DataFrame:
    """Q5.  ``mode="reference"`` keeps the report's quantity inflation (each
    side's quantity times the other side's row count); ``"corrected"`` does not."""
    if mode not in ("reference", "corrected"):
        raise ValueError(mode)
    cut = ts_lit(minus(as_of, days=days))
    a = side_days(t, "Receiving", as_of, "a", "receive_date")
    b = side_days(t, "Shipping", as_of, "b", "ship_date").drop("warehouse_name", "region")
    pairs = pair_days(a, b, cut)
    ref = mode == "reference"
    one = F.lit(1)
    q_recv = (F.col("a_qty").cast(BIG) * (F.col("b_rows") if ref else one).cast(BIG)).cast(BIG)
    q_ship = (F.col("b_qty").cast(BIG) * (F.col("a_rows") if ref else one).cast(BIG)).cast(BIG)
    frac_sign = F.signum(F.col("b_r") * F.col("a_en") - F.col("a_r") * F.col("b_en")).cast("long")
    proc_h = round_half_away((F.col("b_q") - F.col("a_q")) * 2 + frac_sign, F.lit(2 * MICROS_PER_HUNDREDTH_HOUR))
    s = pairs.select(
        "warehouse_name", "region", "receive_date", "ship_date",
        F.col("a_ids").alias("receipts_count"), q_recv.alias("total_quantity_received"),
        F.col("a_hours").alias("avg_receiving_time_hours"),
        F.col("b_ids").alias("shipments_count"), q_ship.alias("total_quantity_shipped"),
        F.col("b_hours").alias("avg_shipping_time_hours"),
        hundredths(proc_h).alias("avg_processing_time_hours"))
    recv, ship = F.col("total_quantity_received"), F.col("total_quantity_shipped")
    hours = {"recv": F.col("avg_receiving_time_hours"), "ship": F.col("avg_shipping_time_hours"),
             "proc": F.col("avg_processing_time_hours")}
    s = s.select(
        "*",
        ladder(R.PROCESSING_EFFICIENCY, {"hours": hours["proc"]}).alias("processing_efficiency"),
        F.when((recv > 0) & (ship > 0), round2(ship.cast(BIG) * 10000, recv)).otherwise(F.lit(0.0))
        .alias("throughput_percentage"),
        ladder(R.OVERALL_PERFORMANCE, hours).alias("overall_performance"))
    return s.select("*", ladder(R.BOTTLENECK, hours).alias("bottleneck_analysis"),
                    ladder(R.IMPROVEMENT, {"perf": F.col("overall_performance")}).alias("improvement_recommendation"))
