"""Classification ladders (searched CASE, first match wins) as data.

Each ladder is a list of ``(conditions, label)`` where ``conditions`` is a tuple
of ``(input, op, bound)`` joined by AND, plus an ELSE label.  A condition on a
NULL input is not true, so NULLs fall through to ELSE, as in SQL.  The same
rule renders as a Spark Column (``ladder``) or as SQL text (``sql_ladder``).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Cond = tuple[str, str, object]


@dataclass(frozen=True)
class Ladder:
    output: str
    rules: tuple[tuple[tuple[Cond, ...], object], ...]
    otherwise: object


def _L(output, rules, otherwise) -> Ladder:
    norm = []
    for conds, label in rules:
        if conds and isinstance(conds[0], str):
            conds = (conds,)
        norm.append((tuple(conds), label))
    return Ladder(output, tuple(norm), otherwise)


# --- Fixed values: enum texts the reports test for. ---------------------------
LOCATION_TYPES = ["storage", "picking", "receiving", "shipping"]
ORDER_COMPLETED, ORDER_PENDING, ORDER_CANCELLED = "completed", "pending", "cancelled"
SHIPMENT_DONE, RECEIPT_DONE, OPEN = "shipped", "received", "pending"
MOVE_IN, MOVE_OUT, MOVE_TRANSFER = "in", "out", "transfer"
ACTIVITY_SHIPPING, ACTIVITY_RECEIVING = "Shipping", "Receiving"

# --- Fixed values: thresholds and labels of the reports, in rule order. ------
STOCK_STATUS = _L("stock_status", [
    (("on_hand", "==", 0), "Out of Stock"),
    (("on_hand", "<=", 10), "Low Stock"),
    (("on_hand", "<=", 50), "Medium Stock"),
], "Well Stocked")

CUSTOMER_SEGMENT = _L("customer_segment", [
    (("orders", ">=", 50), "VIP Customer"),
    (("orders", ">=", 20), "Regular Customer"),
    (("orders", ">=", 5), "Occasional Customer"),
], "New Customer")

PERFORMANCE_CATEGORY = _L("performance_category", [
    ((("revenue_rank", "<=", 3), ("speed_rank", "<=", 3), ("fulfillment_rank", "<=", 3)), "Top Performer"),
    ((("revenue_rank", "<=", 5), ("speed_rank", "<=", 5), ("fulfillment_rank", "<=", 5)), "High Performer"),
    ((("revenue_rank", "<=", 8), ("speed_rank", "<=", 8), ("fulfillment_rank", "<=", 8)), "Average Performer"),
], "Needs Improvement")

DEMAND_TREND = _L("demand_trend", [
    (("trend", ">", 0), "Growing Demand"),
    (("trend", "<", 0), "Declining Demand"),
], "Stable Demand")

# reorder_priority compares forecast (= 1.1 x moving average) with quantity_in
# times a factor; inputs are the exact integers ``11*sum_out`` and
# ``10*n*quantity_in*factor`` (see plans.inventory).
REORDER_FACTORS = [(0.8, "High Reorder Priority"), (0.5, "Medium Reorder Priority")]
REORDER_ELSE = "Low Reorder Priority"

# recency bounds are days before as_of, compared as timestamps
RECENCY_DAYS = [(30, 5), (90, 4), (180, 3), (365, 2)]
RECENCY_ELSE = 1

FREQUENCY_SCORE = _L("frequency_score", [
    (("orders", ">=", 50), 5), (("orders", ">=", 20), 4), (("orders", ">=", 10), 3), (("orders", ">=", 5), 2),
], 1)

MONETARY_SCORE = _L("monetary_score", [
    (("spent", ">=", 10000), 5), (("spent", ">=", 5000), 4), (("spent", ">=", 1000), 3), (("spent", ">=", 500), 2),
], 1)

RFM_SEGMENT = _L("rfm_segment", [
    (("score", ">=", 13), "VIP Customers"),
    (("score", ">=", 10), "High Value Customers"),
    (("score", ">=", 7), "Medium Value Customers"),
    (("score", ">=", 4), "Low Value Customers"),
], "At Risk Customers")

LOYALTY_SEGMENT = _L("loyalty_segment", [
    ((("days", ">=", 365), ("orders", ">=", 20)), "Loyal Long-term"),
    ((("days", ">=", 180), ("orders", ">=", 10)), "Established"),
    ((("days", ">=", 90), ("orders", ">=", 5)), "Growing"),
    ((("days", ">=", 30), ("orders", ">=", 2)), "New Active"),
], "New")

RECOMMENDED_ACTION = _L("recommended_action", [
    (("segment", "==", "VIP Customers"), "Premium Support, Exclusive Offers"),
    (("segment", "==", "High Value Customers"), "Priority Support, Special Discounts"),
    (("segment", "==", "Medium Value Customers"), "Standard Support, Regular Promotions"),
    (("segment", "==", "Low Value Customers"), "Basic Support, Entry-level Offers"),
], "Re-engagement Campaigns")

# BETWEEN is inclusive on both ends and the ranges overlap: first match wins.
TIME_PERIOD = _L("time_period", [
    (("hour", "between", (6, 9)), "Early Morning"),
    (("hour", "between", (9, 12)), "Late Morning"),
    (("hour", "between", (12, 14)), "Lunch Time"),
    (("hour", "between", (14, 17)), "Afternoon"),
    (("hour", "between", (17, 20)), "Evening"),
    (("hour", "between", (20, 23)), "Late Evening"),
], "Night")

DAY_NAME = _L("day_name", [
    (("dow", "==", 0), "Sunday"), (("dow", "==", 1), "Monday"), (("dow", "==", 2), "Tuesday"),
    (("dow", "==", 3), "Wednesday"), (("dow", "==", 4), "Thursday"), (("dow", "==", 5), "Friday"),
], "Saturday")

EFFICIENCY_LEVEL = _L("efficiency_level", [
    (("score", ">=", 10), "Very High"), (("score", ">=", 7), "High"), (("score", ">=", 4), "Medium"),
    (("score", ">=", 1), "Low"),
], "Very Low")

STAFFING = _L("staffing_recommendation", [
    (("orders", ">=", 100), "Peak Hours - Max Staff"),
    (("orders", ">=", 50), "High Activity - Increased Staff"),
    (("orders", ">=", 20), "Moderate Activity - Standard Staff"),
    (("orders", ">=", 5), "Low Activity - Reduced Staff"),
], "Minimal Activity - Minimal Staff")

PROCESSING_EFFICIENCY = _L("processing_efficiency", [
    (("hours", "<=", 2), "Excellent"), (("hours", "<=", 4), "Good"), (("hours", "<=", 8), "Average"),
    (("hours", "<=", 24), "Poor"),
], "Very Poor")

OVERALL_PERFORMANCE = _L("overall_performance", [
    ((("recv", "<=", 1), ("ship", "<=", 2), ("proc", "<=", 4)), "High Performance"),
    ((("recv", "<=", 2), ("ship", "<=", 4), ("proc", "<=", 8)), "Good Performance"),
    ((("recv", "<=", 4), ("ship", "<=", 8), ("proc", "<=", 16)), "Average Performance"),
], "Needs Improvement")

BOTTLENECK = _L("bottleneck_analysis", [
    (("recv", ">", 4), "Receiving bottleneck - Add staff/equipment"),
    (("ship", ">", 8), "Shipping bottleneck - Optimize picking process"),
    (("proc", ">", 16), "Processing bottleneck - Review workflow"),
], "No immediate bottlenecks detected")

IMPROVEMENT = _L("improvement_recommendation", [
    (("perf", "==", "High Performance"), "Maintain current processes"),
    (("perf", "==", "Good Performance"), "Minor optimizations recommended"),
    (("perf", "==", "Average Performance"), "Process review and improvements needed"),
], "Major process redesign required")

# estimated_lag_minutes: bytes / 1024 / 1024 / 16 (one 16 MB log segment per "minute")
LAG_SEGMENT_BYTES = 1024 * 1024 * 16
# ----------------------------------------------------------------------------


def _cond(c: Column, op: str, bound) -> Column:
    if op == "between":
        return c.between(bound[0], bound[1])
    return {"==": c == bound, "<=": c <= bound, ">=": c >= bound, "<": c < bound, ">": c > bound}[op]


def ladder(lad: Ladder, inputs: Mapping[str, Column]) -> Column:
    out = None
    for conds, label in lad.rules:
        pred = None
        for name, op, bound in conds:
            p = _cond(inputs[name], op, bound)
            pred = p if pred is None else pred & p
        # NULL predicates are "not true": coalesce keeps CASE semantics explicit
        pred = F.coalesce(pred, F.lit(False))
        out = F.when(pred, F.lit(label)) if out is None else out.when(pred, F.lit(label))
    return out.otherwise(F.lit(lad.otherwise))


def _sql_lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def sql_ladder(lad: Ladder, inputs: Mapping[str, str]) -> str:
    parts = []
    for conds, label in lad.rules:
        terms = []
        for name, op, bound in conds:
            x = inputs[name]
            if op == "between":
                terms.append(f"{x} BETWEEN {bound[0]} AND {bound[1]}")
            else:
                terms.append(f"{x} {'=' if op == '==' else op} {_sql_lit(bound)}")
        parts.append(f"WHEN {' AND '.join(terms)} THEN {_sql_lit(label)}")
    return f"CASE {' '.join(parts)} ELSE {_sql_lit(lad.otherwise)} END"
