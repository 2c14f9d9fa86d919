"""Inventory reports: V2 summary, V6 movement summary, M2 monthly summary,
M5 30-day movement, Q2 weekly trend + reorder forecast.

Movements are the large table.  Lookups of their from/to location and the
warehouse of either are N:1 joins against small dimensions (broadcast when
their size is known to be small); aggregation happens on the product id and
product attributes are joined to the (much smaller) aggregate afterwards.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.exprs import BIG, bucket, cents, in_bucket, money_from_cents, round2, since, ts_lit
from ..functions.rules import ladder
from ..operators.joins import lookup
from ..sources.tables import Tables

PRODUCT_COLS = ["product_id", "product_name", "product_category", "sku", "unit_of_measure"]


def inventory_rollup(inventory: DataFrame) -> DataFrame:
    """Per product: stock sums, location count ((product, location) is the key),
    cost parts, stock value and last update."""
    on_hand, alloc, cost = F.col("quantity_on_hand"), F.col("quantity_allocated"), F.col("unit_cost")
    return inventory.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n_inv"),
        F.sum(on_hand).alias("sum_on_hand"), F.sum(alloc).alias("sum_alloc"),
        F.sum(on_hand - alloc).alias("sum_avail"),
        F.count("location_id").alias("locations_count"),
        F.sum(cents(cost)).alias("cost_cents"), F.count(cost).alias("cost_n"),
        F.sum(on_hand * cents(cost)).alias("value_cents"),
        F.max("last_updated").alias("last_inventory_update"))


def _stock_measures(factor: Column | None = None) -> list[Column]:
    f = (lambda c: (c.cast(BIG) * factor).cast(BIG)) if factor is not None else (lambda c: c)
    on_hand = F.coalesce(f(F.col("sum_on_hand")), F.lit(0))
    return [on_hand.alias("total_quantity_on_hand"),
            F.coalesce(f(F.col("sum_alloc")), F.lit(0)).alias("total_quantity_allocated"),
            F.coalesce(f(F.col("sum_avail")), F.lit(0)).alias("available_quantity"),
            F.coalesce(F.col("locations_count"), F.lit(0)).alias("locations_count"),
            round2(F.col("cost_cents"), F.col("cost_n")).alias("avg_unit_cost"),
            money_from_cents(f(F.col("value_cents"))).alias("total_inventory_value"),
            F.col("last_inventory_update")]


def _stock_status(on_hand_col: str = "total_quantity_on_hand") -> Column:
    return ladder(R.STOCK_STATUS, {"on_hand": F.col(on_hand_col)}).alias("stock_status")


def inventory_summary(t: Tables) -> DataFrame:
    """V2: one row per product with stock figures and a stock-status label."""
    j = t["products"].select(*PRODUCT_COLS).join(inventory_rollup(t["inventory"]), "product_id", "left")
    return j.select(*PRODUCT_COLS, *_stock_measures()).withColumn("stock_status", _stock_status())


def _type_qty(mtype: str) -> Column:
    """SUM(CASE WHEN movement_type = mtype THEN quantity_moved ELSE 0 END) input."""
    return F.when(F.col("movement_type") == mtype, F.col("quantity_moved")).otherwise(F.lit(0))


def monthly_inventory_summary(t: Tables, as_of: dt.date, mode: str = "reference") -> DataFrame:
    """M2: V2 plus the movements of as_of's month.

    ``mode="reference"`` reproduces the SQL's product x inventory x movement
    fan-out: stock figures are multiplied by max(1,#movements) (and the stock
    status is taken on that figure), in/out sums by max(1,#inventory rows).
    ``mode="corrected"`` reports each side once.
    """
    if mode not in ("reference", "corrected"):
        raise ValueError(mode)
    mov = (t["inventory_movements"].where(in_bucket(F.col("movement_date"), "month", as_of))
           .groupBy("product_id").agg(
               F.count(F.lit(1)).alias("n_mov"), F.count_distinct("movement_id").alias("movements_this_month"),
               F.sum(_type_qty(R.MOVE_IN)).alias("sum_in"), F.sum(_type_qty(R.MOVE_OUT)).alias("sum_out")))
    j = (t["products"].select(*PRODUCT_COLS)
         .join(inventory_rollup(t["inventory"]), "product_id", "left")
         .join(mov, "product_id", "left"))
    ref = mode == "reference"
    f_mov = (F.coalesce(F.col("n_mov"), F.lit(1)) if ref else F.lit(1)).cast(BIG)
    f_inv = (F.coalesce(F.col("n_inv"), F.lit(1)) if ref else F.lit(1)).cast(BIG)
    no_mov = F.col("n_mov").isNull()
    return j.select(
        ts_lit(dt.datetime(as_of.year, as_of.month, 1)).alias("summary_month"), *PRODUCT_COLS,
        *_stock_measures(f_mov),
        F.coalesce(F.col("movements_this_month"), F.lit(0)).alias("movements_this_month"),
        F.when(no_mov, F.lit(0)).otherwise((F.col("sum_in").cast(BIG) * f_inv).cast(BIG)).cast(BIG).alias("total_quantity_in"),
        F.when(no_mov, F.lit(0)).otherwise((F.col("sum_out").cast(BIG) * f_inv).cast(BIG)).cast(BIG).alias("total_quantity_out"),
    ).withColumn("stock_status", _stock_status())


def _with_warehouse_key(t: Tables, movements: DataFrame) -> DataFrame:
    """Movements with ``wh_key``, the warehouse id of their from- (else to-) location."""
    loc = t["locations"].select("location_id", "warehouse_id")
    fl = loc.select(F.col("location_id").alias("from_location_id"), F.col("warehouse_id").alias("fl_wh"))
    tl = loc.select(F.col("location_id").alias("to_location_id"), F.col("warehouse_id").alias("tl_wh"))
    m = lookup(lookup(movements, fl, "from_location_id"), tl, "to_location_id")
    return m.withColumn("wh_key", F.coalesce(F.col("fl_wh"), F.col("tl_wh"))).drop("fl_wh", "tl_wh")


def _with_warehouse(t: Tables, movements: DataFrame) -> DataFrame:
    """Rows with a ``wh_key`` and their warehouse in its place."""
    w = t["warehouses"].select(F.col("warehouse_id").alias("wh_key"), "warehouse_id", "warehouse_name")
    return lookup(movements, w, "wh_key").drop("wh_key")


def movements_with_warehouse(t: Tables, movements: DataFrame) -> DataFrame:
    """Movements with the warehouse of their from- (else to-) location.

    Two N:1 lookups into locations and one into warehouses on the computed
    ``COALESCE`` key (still an equi-join).  Unmatched lookups give NULL; rows
    without a location are spread (``operators.joins.lookup``).
    """
    return _with_warehouse(t, _with_warehouse_key(t, movements))


def product_movement_summary(t: Tables) -> DataFrame:
    """V6: per product, day, type, from/to location and warehouse *name*.

    The warehouse is COALESCE(warehouse(from), warehouse(to)), a function of
    (from, to), so grouping by the name adds nothing to the (product, day,
    type, from, to) grouping: movements are aggregated first and the three
    lookups run on the aggregated rows, not on every movement.  Movements are
    shuffled once, on all five columns, for the distinct ids and the sums; the
    day is a date and the warehouse an id until the last shuffle is over.
    """
    qty, cost = F.col("quantity_moved"), F.col("unit_cost")
    group = ["product_id", "movement_date", "movement_type", "from_location_id", "to_location_id"]
    m = t["inventory_movements"].select("movement_id", *group, qty, cost).withColumn("movement_date", F.col("movement_date").cast("date"))
    # where the rows of a group lie together, the first row of an id is told by their order; a distinct count would hash them four times
    new = ~F.lag("movement_id").over(Window.partitionBy(*group).orderBy("movement_id")).eqNullSafe(F.col("movement_id"))
    g = m.repartition(*group).withColumn("new", new).groupBy(*group).agg(
        F.sum(qty).alias("total_quantity_moved"),
        F.count(F.when(F.col("new"), F.col("movement_id"))).alias("movement_count"),
        F.sum(cents(cost)).alias("cost_cents"), F.count(cost).alias("cost_n"),
        F.sum(qty * cents(cost)).alias("value_cents"))
    p = t["products"].select("product_id", "product_name", "product_category")
    return _with_warehouse(t, _with_warehouse_key(t, g).join(p, "product_id", "inner")).select(
        "product_id", "product_name", "product_category", F.col("movement_date").cast("timestamp_ntz").alias("movement_date"), "movement_type",
        "from_location_id", "to_location_id", "total_quantity_moved", "movement_count",
        round2(F.col("cost_cents"), F.col("cost_n")).alias("avg_unit_cost"),
        money_from_cents(F.col("value_cents")).alias("total_movement_value"), "warehouse_name")


def product_movement_30days(t: Tables, as_of: dt.date) -> DataFrame:
    """M5: per product, movements since as_of - 30 days (no upper bound)."""
    recent = t["inventory_movements"].where(since(F.col("movement_date"), as_of, days=30))
    qty, cost = F.col("quantity_moved"), F.col("unit_cost")
    g = recent.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n_mov"), F.count_distinct("movement_id").alias("total_movements"),
        F.sum(_type_qty(R.MOVE_IN)).alias("sum_in"), F.sum(_type_qty(R.MOVE_OUT)).alias("sum_out"),
        F.sum(_type_qty(R.MOVE_TRANSFER)).alias("sum_tr"), F.sum(cents(cost)).alias("cost_cents"), F.count(cost).alias("cost_n"),
        F.sum(qty * cents(cost)).alias("value_cents"),
        F.max("movement_date").alias("last_movement_date"), F.min("movement_date").alias("first_movement_date"))
    # distinct places by explicit dedupes: the lookups run on distinct routes, and no set is ever held in one row
    routes = movements_with_warehouse(t, recent.select("product_id", "from_location_id", "to_location_id").distinct())
    place = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("place"))
                               for k, c in enumerate(("from_location_id", "to_location_id", "warehouse_id"))]))
    places = routes.select("product_id", place).where(F.col("place").isNotNull()).distinct().groupBy("product_id").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(n)
          for k, n in enumerate(("unique_from_locations", "unique_to_locations", "warehouses_involved"))])
    g = g.join(places, "product_id", "left")
    j = t["products"].select("product_id", "product_name", "product_category", "sku").join(g, "product_id", "left")
    no_mov = F.col("n_mov").isNull()
    zero = lambda c: F.when(no_mov, F.lit(0)).otherwise(F.coalesce(F.col(c), F.lit(0)))
    return j.select(
        F.lit(as_of).alias("summary_date"), "product_id", "product_name", "product_category", "sku",
        zero("total_movements").alias("total_movements"),
        zero("sum_in").alias("total_quantity_in"), zero("sum_out").alias("total_quantity_out"),
        zero("sum_tr").alias("total_quantity_transferred"),
        round2(F.col("cost_cents"), F.col("cost_n")).alias("avg_unit_cost"),
        money_from_cents(F.col("value_cents")).alias("total_movement_value"),
        zero("unique_from_locations").alias("unique_from_locations"),
        zero("unique_to_locations").alias("unique_to_locations"),
        zero("warehouses_involved").alias("warehouses_involved"),
        "last_movement_date", "first_movement_date")


def inventory_forecast(t: Tables, as_of: dt.date) -> DataFrame:
    """Q2: weekly in/out per product over 16 weeks (no upper bound), 4-row moving
    average of the outflow, week-over-week change and a reorder label.

    The window runs per product over at most one row per week, so even a hot
    product's partition is small; the frame is 4 *rows*, not 4 calendar weeks.
    Forecast comparisons are exact integer inequalities:
    1.1*S/n > f*q  <=>  11*S > 10*f*n*q.
    """
    mov = t["inventory_movements"].where(since(F.col("movement_date"), as_of, days=16 * 7))
    cost = F.col("unit_cost")
    weekly = mov.groupBy("product_id", bucket(F.col("movement_date"), "week").alias("week")).agg(
        F.sum(_type_qty(R.MOVE_IN)).alias("quantity_in"), F.sum(_type_qty(R.MOVE_OUT)).alias("quantity_out"),
        F.sum(_type_qty(R.MOVE_TRANSFER)).alias("quantity_transfer"),
        F.count_distinct("movement_id").alias("movement_count"),
        (F.sum(cents(cost)).cast("double") / F.lit(100.0) / F.count(cost)).alias("avg_unit_cost"))
    p = t["products"].select("product_id", "product_name", "product_category", "sku")
    weekly = weekly.join(p, "product_id", "inner")
    by_week = Window.partitionBy("product_id").orderBy("week")
    frame = by_week.rowsBetween(-3, Window.currentRow)
    out_s, out_n = F.sum("quantity_out").over(frame), F.count("quantity_out").over(frame)
    f = weekly.select("*", out_s.alias("_s"), out_n.alias("_n"),
                      (F.col("quantity_out") - F.lag("quantity_out", 1).over(by_week)).alias("consumption_trend"))
    s, n, qin = F.col("_s").cast(BIG), F.col("_n").cast(BIG), F.col("quantity_in").cast(BIG)
    reorder = None
    for factor, label in R.REORDER_FACTORS:
        cond = F.coalesce(s * 11 > n * qin * int(round(factor * 10)), F.lit(False))
        reorder = F.when(cond, label) if reorder is None else reorder.when(cond, label)
    reorder = reorder.otherwise(R.REORDER_ELSE)
    return f.select(
        "product_name", "product_category", "sku", "week", "quantity_in", "quantity_out", "quantity_transfer",
        "movement_count", "avg_unit_cost",
        round2(s * 100, n).alias("avg_weekly_consumption"), "consumption_trend",
        round2(s * 110, n).alias("forecast_next_week"),
        ladder(R.DEMAND_TREND, {"trend": F.col("consumption_trend")}).alias("demand_trend"),
        reorder.alias("reorder_priority"))
