"""Customer reports: V4 insights, M4 lifetime value, Q3 RFM + loyalty.

customers LEFT JOIN orders LEFT JOIN order_items is computed as: items ->
one row per order (``order_rollup``) -> one row per customer (partial
aggregation absorbs a customer that owns a third of all orders) -> 1:1 join
to customers.  Orders with a NULL customer never match and drop out.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.exprs import (avg_hours2, money_from_cents, pct, round2, ts_lit, whole_days_between,
                               minus)
from ..functions.rules import ladder
from ..operators.joins import lookup
from ..operators.rollups import order_rollup, weighted_hours_aggs
from ..sources.tables import Tables

CUSTOMER_COLS = ["customer_id", "customer_name", "customer_type", "region", "country"]


def customer_rollup(t: Tables) -> DataFrame:
    per = order_rollup(t["orders"], t["order_items"])
    oid, st = F.col("order_id"), F.col("status")
    return per.groupBy("customer_id").agg(
        F.count(oid).alias("n_orders"), F.sum("value_cents").alias("spent_cents"),
        F.sum("value_n").alias("value_n"),
        F.max("order_date").alias("last_order_date"), F.min("order_date").alias("first_order_date"),
        *weighted_hours_aggs(),
        F.count(F.when(st == R.ORDER_COMPLETED, oid)).alias("completed"),
        F.count(F.when(st == R.ORDER_CANCELLED, oid)).alias("cancelled"))


def _joined(t: Tables) -> DataFrame:
    c = t["customers"].select(*CUSTOMER_COLS)
    return c.join(customer_rollup(t), "customer_id", "left")


def _insight_cols() -> dict[str, Column]:
    total = F.coalesce(F.col("n_orders"), F.lit(0))
    done = F.coalesce(F.col("completed"), F.lit(0))
    return {
        "total_orders": total,
        "total_spent": money_from_cents(F.col("spent_cents")),
        "avg_order_value": round2(F.col("spent_cents"), F.col("value_n")),
        "last_order_date": F.col("last_order_date"),
        "first_order_date": F.col("first_order_date"),
        "avg_fulfillment_time_hours": avg_hours2(F.col("h_sum"), F.col("h_n")),
        "completed_orders": done,
        "cancelled_orders": F.coalesce(F.col("cancelled"), F.lit(0)),
        "order_completion_rate": pct(done, total),
        "customer_segment": ladder(R.CUSTOMER_SEGMENT, {"orders": total}),
    }


def customer_insights(t: Tables) -> DataFrame:
    """V4: one row per customer (NULL spenders sort first in the report order)."""
    return _joined(t).select(*CUSTOMER_COLS, *[c.alias(n) for n, c in _insight_cols().items()])


def _lifetime(as_of: dt.date) -> dict[str, Column]:
    days = whole_days_between(F.col("first_order_date"), as_of)
    return {"customer_lifetime_days": days,
            "daily_spending_rate": round2(F.col("spent_cents"), days)}


def customer_lifetime_value(t: Tables, as_of: dt.date) -> DataFrame:
    """M4: V4 plus lifetime days (truncated toward zero) and spend per day."""
    cols = {**_insight_cols(), **_lifetime(as_of)}
    return _joined(t).select(ts_lit(dt.datetime(as_of.year, as_of.month, 1)).alias("summary_month"),
                             *CUSTOMER_COLS, *[c.alias(n) for n, c in cols.items()])


def categories_per_customer(t: Tables) -> DataFrame:
    """COUNT(DISTINCT product_category) per customer over their order lines.

    Lines are reduced to distinct (customer, product) pairs first (repeat
    purchases collapse map-side), so the category lookup runs on those pairs
    rather than on every line; the set of (customer, category) pairs is the
    same.  A hot customer is spread by the (customer, value) shuffles."""
    items = t["order_items"].select("order_id", "product_id")
    orders = t["orders"].select("order_id", "customer_id").where(F.col("customer_id").isNotNull())
    bought = items.join(orders, "order_id", "inner").select("customer_id", "product_id").distinct()
    cat = t["products"].select("product_id", "product_category")
    pairs = lookup(bought, cat, "product_id", "inner")
    return pairs.groupBy("customer_id").agg(F.count_distinct("product_category").alias("product_categories_purchased"))


def customer_rfm(t: Tables, as_of: dt.date) -> DataFrame:
    """Q3: behaviour, RFM scores, RFM and loyalty segments, recommended action."""
    base = _joined(t).join(categories_per_customer(t), "customer_id", "left")
    cols = {**_insight_cols(), **_lifetime(as_of)}
    b = base.select(*CUSTOMER_COLS, *[c.alias(n) for n, c in cols.items()],
                    F.coalesce(F.col("product_categories_purchased"), F.lit(0)).alias("product_categories_purchased"),
                    F.col("spent_cents"))
    recency = None
    for days, score in R.RECENCY_DAYS:
        cond = F.coalesce(F.col("last_order_date") >= ts_lit(minus(as_of, days=days)), F.lit(False))
        recency = F.when(cond, score) if recency is None else recency.when(cond, score)
    recency = recency.otherwise(R.RECENCY_ELSE)
    freq = ladder(R.FREQUENCY_SCORE, {"orders": F.col("total_orders")})
    # monetary bounds are whole currency units: compare exact cents
    money = ladder(R.MONETARY_SCORE, {"spent": F.col("spent_cents") / F.lit(100)})
    score = (recency + freq + money).cast("long")
    s = b.withColumn("rfm_score", score)
    seg = ladder(R.RFM_SEGMENT, {"score": F.col("rfm_score")})
    s = s.withColumn("rfm_segment", seg).withColumn(
        "loyalty_segment", ladder(R.LOYALTY_SEGMENT, {"days": F.col("customer_lifetime_days"),
                                                      "orders": F.col("total_orders")}))
    return s.select(
        "customer_name", "customer_type", "region", "country", "total_orders", "total_spent", "avg_order_value",
        "first_order_date", "last_order_date", "customer_lifetime_days", "daily_spending_rate",
        "order_completion_rate", "product_categories_purchased", "rfm_score", "rfm_segment", "loyalty_segment",
        ladder(R.RECOMMENDED_ACTION, {"segment": F.col("rfm_segment")}).alias("recommended_action"))
