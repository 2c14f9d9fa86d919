"""Boundary tests of the ladders computed inside reports
and window NULL placement (W2), on literal logical tables."""
import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from depotlens.functions import rules as R
from depotlens.plans import customers, health, inventory, orders, supply_chain
from depotlens.sources.fixtures import AS_OF
from depotlens.sources.tables import SCHEMAS

D = dt.datetime


def tables(spark, **rows):
    return {n: spark.createDataFrame(rows.get(n, []), SCHEMAS[n]) for n in SCHEMAS}


def test_reorder_priority_bounds(spark):
    # one product per case, one week (n = 1): forecast = 1.1 * out vs in * 0.8 / 0.5
    wk = D(2001, 6, 25, 10)
    mov, prods = [], []
    cases = {1: (8, 11, "Medium Reorder Priority"),   # 8.8 == 11 * 0.8 -> not High; 8.8 > 5.5 -> Medium
             2: (9, 11, "High Reorder Priority"),     # 9.9 > 8.8
             3: (5, 11, "Low Reorder Priority"),      # 5.5 == 5.5 -> not Medium
             4: (6, 11, "Medium Reorder Priority")}   # 6.6 > 5.5
    for p, (out_q, in_q, _) in cases.items():
        prods.append((p, f"p{p}", "A", f"S{p}", "EA"))
        mov.append((f"o{p}", p, "out", wk, out_q, Decimal("1.00"), 1, None))
        mov.append((f"i{p}", p, "in", wk, in_q, Decimal("1.00"), None, 1))
    t = tables(spark, products=prods, inventory_movements=mov)
    got = {r.product_name: r.reorder_priority for r in inventory.inventory_forecast(t, AS_OF).collect()}
    assert got == {f"p{p}": c[2] for p, c in cases.items()}


def test_recency_bounds(spark):
    cust = [(c, f"c{c}", "X", "EU", "FR") for c in range(1, 6)]
    c30 = D(2001, 6, 1)
    last = {1: c30, 2: c30 - dt.timedelta(microseconds=1), 3: D(2000, 7, 1), 4: D(2000, 6, 30, 23), 5: None}
    ords = [(c, c, 1, "completed", ts, None) for c, ts in last.items() if ts is not None]
    t = tables(spark, customers=cust, orders=ords)
    rows = {r.customer_name: r.rfm_score for r in customers.customer_rfm(t, AS_OF).collect()}
    # frequency 1 and monetary 1 (no lines): score = recency + 2
    assert rows == {"c1": 7, "c2": 6, "c3": 4, "c4": 3, "c5": 3}


def test_throughput_and_recommendation(spark):
    wh = [(1, "W", "L1", "EU")]
    day = D(2001, 6, 20)
    recs = [(10, 1, day + dt.timedelta(hours=1), day, "received")]
    ships = [(11, 1, day + dt.timedelta(hours=2), day, "shipped"), (13, 1, day + dt.timedelta(hours=2), day, "shipped")]
    t = tables(spark, warehouses=wh, receipts=recs, shipments=ships,
               receipt_items=[(10, 0)], shipment_items=[(11, 3), (13, 4)])
    r = supply_chain.supply_chain(t, AS_OF).collect()
    assert len(r) == 1
    row = r[0]
    assert row.total_quantity_received == 0 and row.throughput_percentage == 0.0   # received = 0 -> 0
    assert row.avg_processing_time_hours == 1.0 and row.processing_efficiency == "Excellent"
    assert row.overall_performance == "High Performance"
    assert row.improvement_recommendation == "Maintain current processes"


def test_improvement_ladder(spark):
    df = spark.createDataFrame([(x,) for x in ["High Performance", "Good Performance", "Average Performance",
                                               "Needs Improvement", None]], "p string")
    got = [r[0] for r in df.select(R.ladder(R.IMPROVEMENT, {"perf": F.col("p")})).collect()]
    assert got == ["Maintain current processes", "Minor optimizations recommended",
                   "Process review and improvements needed", "Major process redesign required",
                   "Major process redesign required"]


def test_lag_minutes_bounds(spark):
    seg = 16 * 1024 * 1024

    def lsn(n):
        return f"{n >> 32:X}/{n & 0xFFFFFFFF:X}"
    base = 5 << 32
    rows = [(i, D(2024, 1, 1), lsn(base), lsn(base), lsn(base), lsn(base), lsn(base - d))
            for i, d in enumerate([0, 1, seg // 2, seg, seg * 3 + seg // 200, seg * 3 + seg // 200 + 1])]
    s = spark.createDataFrame(rows, "sample_id long, sample_ts timestamp_ntz, current_lsn string, "
                                    "sent_lsn string, write_lsn string, flush_lsn string, replay_lsn string")
    got = [r.estimated_lag_minutes for r in health.replication_lag(s).orderBy("sample_id").collect()]
    assert got == [0.0, 0.0, 0.5, 1.0, 3.0, 3.01]


def test_speed_rank_puts_null_hours_last(spark):
    wh = [(w, f"W{w}", f"L{w}", "EU") for w in (1, 2, 3)]
    od = D(2001, 6, 10, 8)
    ords = [(1, 1, 1, "completed", od, od + dt.timedelta(hours=5)),
            (2, 1, 2, "completed", od, None),                       # warehouse 2: no ship date -> NULL hours
            (3, 1, 3, "completed", od, od + dt.timedelta(hours=1))]
    t = tables(spark, warehouses=wh, orders=ords)
    got = {r.warehouse_name: r.speed_rank for r in orders.warehouse_monthly_ranking(t, AS_OF).collect()}
    assert got == {"W3": 1, "W1": 2, "W2": 3}
