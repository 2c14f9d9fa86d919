"""Per-parent pre-aggregations that replace one-to-many join fan-out.

The reports join a parent (order, shipment, receipt, warehouse, product) to
its children and then aggregate.  Joining first multiplies parent attributes
by the child count and forces several ``COUNT(DISTINCT)`` Expand passes over
the widest frame.  Instead each child table is aggregated to one row per
parent key (partial aggregation map-side, one shuffle on the key) and joined
1:1 to its parent; a parent with ``n`` children stands for ``max(1, n)``
joined rows, which is the weight of its attributes in line-weighted averages.

Hot keys: a parent key that owns a third of all children is reduced by the
map-side partial aggregate before the shuffle, so no task ever receives the
hot key's raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import BIG, cents, micros_between


def child_rollup(children: DataFrame, key: str, aggs: dict[str, Column]) -> DataFrame:
    """One row per ``key`` with ``n_child`` (row count) plus named aggregates."""
    exprs = [F.count(F.lit(1)).alias("n_child")] + [c.alias(n) for n, c in aggs.items()]
    return children.groupBy(key).agg(*exprs)


def attach(parent: DataFrame, rollup: DataFrame, key: str) -> DataFrame:
    """parent LEFT JOIN rollup on key, with ``w`` = joined-row weight max(1, n)."""
    j = parent.join(rollup, key, "left")
    return j.withColumn("w", F.coalesce(F.col("n_child"), F.lit(1)).cast("long"))


def item_aggs(distinct_items: bool = False) -> dict[str, Column]:
    """Aggregates of order_items per order (all exact integers)."""
    qty, price = F.col("quantity_ordered"), F.col("unit_price")
    value = qty * cents(price)
    aggs = {
        "sum_ordered": F.sum(qty),
        "sum_shipped": F.sum("quantity_shipped"),
        "sum_backordered": F.sum("quantity_backordered"),
        "n_ordered": F.count(qty),
        "price_cents": F.sum(cents(price)),
        "price_n": F.count(price),
        "value_cents": F.sum(value),
        "value_n": F.count(value),
    }
    if distinct_items:
        aggs["n_items"] = F.count_distinct("order_item_id")
    return aggs


def order_rollup(orders: DataFrame, order_items: DataFrame, distinct_items: bool = False,
                 inner: bool = False, restrict: bool = False) -> DataFrame:
    """One row per order with its item aggregates and fulfillment micros.

    ``inner=True`` keeps only orders with at least one line (inner join form);
    then the weight is the line count itself.  ``restrict=True`` (for date-
    filtered orders) first prunes the lines to those orders through a
    semi-join, so only their lines are aggregated.
    """
    if restrict:
        from .joins import restrict_to_keys
        order_items = restrict_to_keys(order_items, orders, "order_id")
    items = child_rollup(order_items, "order_id", item_aggs(distinct_items))
    if inner:
        j = orders.join(items, "order_id", "inner").withColumn("w", F.col("n_child").cast("long"))
    else:
        j = attach(orders, items, "order_id")
    return j.withColumn("ship_us", micros_between(F.col("order_date"), F.col("ship_date")))


def weighted_hours_aggs(micros: str = "ship_us", weight: str = "w") -> list[Column]:
    """Line-weighted duration sum (decimal, no ANSI overflow) and weight count."""
    m, w = F.col(micros), F.col(weight)
    return [F.sum(m.cast(BIG) * w).alias("h_sum"),
            F.sum(F.when(m.isNotNull(), w)).alias("h_n")]
