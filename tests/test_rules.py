"""Boundary tests of every classification ladder: bound, bound +- 1, NULL."""
import pytest
from pyspark.sql import functions as F

from depotlens.functions import rules as R


def _labels(spark, lad, inputs_rows, names):
    schema = ", ".join(f"{n} double" for n in names)
    df = spark.createDataFrame(inputs_rows, schema)
    return [r[0] for r in df.select(R.ladder(lad, {n: F.col(n) for n in names})).collect()]


CASES = [
    (R.STOCK_STATUS, "on_hand", [(0, "Out of Stock"), (1, "Low Stock"), (10, "Low Stock"), (11, "Medium Stock"),
                                 (50, "Medium Stock"), (51, "Well Stocked"), (-1, "Low Stock"),
                                 (None, "Well Stocked")]),
    (R.CUSTOMER_SEGMENT, "orders", [(50, "VIP Customer"), (49, "Regular Customer"), (20, "Regular Customer"),
                                    (19, "Occasional Customer"), (5, "Occasional Customer"), (4, "New Customer"),
                                    (None, "New Customer")]),
    (R.DEMAND_TREND, "trend", [(1, "Growing Demand"), (0, "Stable Demand"), (-1, "Declining Demand"),
                               (None, "Stable Demand")]),
    (R.FREQUENCY_SCORE, "orders", [(50, 5), (49, 4), (20, 4), (19, 3), (10, 3), (9, 2), (5, 2), (4, 1),
                                   (None, 1)]),
    (R.MONETARY_SCORE, "spent", [(10000, 5), (9999.99, 4), (5000, 4), (4999.99, 3), (1000, 3), (999.99, 2),
                                 (500, 2), (499.99, 1), (None, 1)]),
    (R.RFM_SEGMENT, "score", [(13, "VIP Customers"), (12, "High Value Customers"), (10, "High Value Customers"),
                              (9, "Medium Value Customers"), (7, "Medium Value Customers"),
                              (6, "Low Value Customers"), (4, "Low Value Customers"), (3, "At Risk Customers")]),
    (R.TIME_PERIOD, "hour", [(5, "Night"), (6, "Early Morning"), (9, "Early Morning"), (10, "Late Morning"),
                             (12, "Late Morning"), (13, "Lunch Time"), (14, "Lunch Time"), (15, "Afternoon"),
                             (17, "Afternoon"), (18, "Evening"), (20, "Evening"), (21, "Late Evening"),
                             (23, "Late Evening"), (0, "Night"), (None, "Night")]),
    (R.DAY_NAME, "dow", [(0, "Sunday"), (1, "Monday"), (2, "Tuesday"), (3, "Wednesday"), (4, "Thursday"),
                         (5, "Friday"), (6, "Saturday"), (None, "Saturday")]),
    (R.EFFICIENCY_LEVEL, "score", [(10, "Very High"), (9.99, "High"), (7, "High"), (6.99, "Medium"),
                                   (4, "Medium"), (3.99, "Low"), (1, "Low"), (0.99, "Very Low"),
                                   (None, "Very Low")]),
    (R.STAFFING, "orders", [(100, "Peak Hours - Max Staff"), (99, "High Activity - Increased Staff"),
                            (50, "High Activity - Increased Staff"), (49, "Moderate Activity - Standard Staff"),
                            (20, "Moderate Activity - Standard Staff"), (19, "Low Activity - Reduced Staff"),
                            (5, "Low Activity - Reduced Staff"), (4, "Minimal Activity - Minimal Staff")]),
    (R.PROCESSING_EFFICIENCY, "hours", [(-3, "Excellent"), (2, "Excellent"), (2.01, "Good"), (4, "Good"),
                                        (4.01, "Average"), (8, "Average"), (8.01, "Poor"), (24, "Poor"),
                                        (24.01, "Very Poor"), (None, "Very Poor")]),
]


@pytest.mark.parametrize("lad,name,cases", CASES, ids=[c[0].output for c in CASES])
def test_single_input_ladder(spark, lad, name, cases):
    got = _labels(spark, lad, [(None if v is None else float(v),) for v, _ in cases], [name])
    assert got == [e for _, e in cases]


def test_multi_input_ladders(spark):
    perf = _labels(spark, R.PERFORMANCE_CATEGORY,
                   [(3., 3., 3.), (3., 4., 3.), (5., 5., 5.), (6., 1., 1.), (8., 8., 8.), (9., 1., 1.)],
                   ["revenue_rank", "speed_rank", "fulfillment_rank"])
    assert perf == ["Top Performer", "High Performer", "High Performer", "Average Performer",
                    "Average Performer", "Needs Improvement"]
    loyal = _labels(spark, R.LOYALTY_SEGMENT,
                    [(365., 20.), (365., 19.), (180., 10.), (179., 10.), (90., 5.), (30., 2.), (29., 2.),
                     (None, 50.)], ["days", "orders"])
    assert loyal == ["Loyal Long-term", "Established", "Established", "Growing", "Growing", "New Active", "New",
                     "New"]
    overall = _labels(spark, R.OVERALL_PERFORMANCE,
                      [(1., 2., 4.), (1.01, 2., 4.), (2., 4., 8.), (4., 8., 16.), (4., 8., 16.01),
                       (None, 1., 1.), (1., 1., None)], ["recv", "ship", "proc"])
    assert overall == ["High Performance", "Good Performance", "Good Performance", "Average Performance",
                       "Needs Improvement", "Needs Improvement", "Needs Improvement"]
    bott = _labels(spark, R.BOTTLENECK, [(4.01, 9., 17.), (4., 8.01, 17.), (4., 8., 16.01), (4., 8., 16.),
                                         (None, None, None)], ["recv", "ship", "proc"])
    assert bott == ["Receiving bottleneck - Add staff/equipment", "Shipping bottleneck - Optimize picking process",
                    "Processing bottleneck - Review workflow", "No immediate bottlenecks detected",
                    "No immediate bottlenecks detected"]


def test_string_ladders(spark):
    df = spark.createDataFrame([("VIP Customers",), ("High Value Customers",), ("Medium Value Customers",),
                                ("Low Value Customers",), ("At Risk Customers",), (None,)], "s string")
    got = [r[0] for r in df.select(R.ladder(R.RECOMMENDED_ACTION, {"segment": F.col("s")})).collect()]
    assert got == ["Premium Support, Exclusive Offers", "Priority Support, Special Discounts",
                   "Standard Support, Regular Promotions", "Basic Support, Entry-level Offers",
                   "Re-engagement Campaigns", "Re-engagement Campaigns"]


def test_sql_ladder_renders_same_rules():
    sql = R.sql_ladder(R.TIME_PERIOD, {"hour": "h"})
    assert sql.startswith("CASE WHEN h BETWEEN 6 AND 9 THEN 'Early Morning'")
    assert sql.endswith("ELSE 'Night' END")
