"""One plan at every size, inflated sums beyond a long, split keys, and an oracle that reads no rule table."""
import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from depotlens.checks import oracle
from depotlens.checks.compare import compare, duckdb_con
from depotlens.functions import rules as R
from depotlens.operators import snapshots as S
from depotlens.operators.joins import lookup
from depotlens.plans import inventory, primitives, supply_chain, warehouse
from depotlens.sources.fixtures import AS_OF
from depotlens.sources.tables import PRIMARY_KEYS, SCHEMAS


@pytest.fixture()
def no_broadcast(spark):
    """As with large tables: no broadcast, and partitions too large to be coalesced."""
    large = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in large}
    for k, v in large.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["m3_weekly_order_summary", "q1_warehouse_monthly_ranking", "q4_hourly_operations", "m6_daily_shipping_receiving"])
def test_lines_are_pruned_below_their_aggregate(spark, no_broadcast, key):
    text = executed(E.queries()[key](spark, SF_SMALL))
    lines = text.splitlines()
    semi = [i for i, ln in enumerate(lines) if "LeftSemi" in ln]
    assert semi and "Broadcast" not in text
    depth = lambda ln: len(ln) - len(ln.lstrip(" :+-"))
    for i in semi:  # an aggregate of the lines stands above the semi-join
        assert any("HashAggregate" in ln and "partial_" in ln and depth(ln) < depth(lines[i]) for ln in lines[:i])


def test_building_runs_no_job(spark):
    """Registered report callables return plans."""
    sc = spark.sparkContext
    before = sc.statusTracker().getJobIdsForGroup()
    sc.setJobGroup("building", "plans only")
    skip = {"export_snapshot", "pipeline", "r_refresh_daily", "r_refresh_weekly", "r_refresh_monthly"}  # these write and read back by their nature
    for key, build in E.queries().items():
        if key not in skip and not (key.startswith("op") and key[2].isdigit()):
            build(spark, SF_SMALL)
    assert list(sc.statusTracker().getJobIdsForGroup("building")) == []
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert before is not None


def _tables(spark, **rows):
    return {n: spark.createDataFrame(rows.get(n, []), SCHEMAS[n]) for n in SCHEMAS}


def test_product_of_counts_beyond_a_long(spark):
    day, n = dt.datetime(2001, 7, 1, 5), 3000
    big = 10**9
    t = _tables(spark, warehouses=[(1, "W", "L", "R")],
                locations=[(i, 1, "storage", None, big, big) for i in range(1000)])
    ids = spark.range(n).select("id")
    t["orders"] = ids.select(F.col("id").alias("order_id"), F.lit(1).cast("long").alias("customer_id"), F.lit(1).cast("long").alias("warehouse_id"),
                             F.lit("pending").alias("status"), F.lit(day).cast("timestamp_ntz").alias("order_date"), F.lit(None).cast("timestamp_ntz").alias("ship_date"))
    for name, key, ts in (("shipments", "shipment_id", "ship_date"), ("receipts", "receipt_id", "receive_date")):
        t[name] = ids.select(F.col("id").alias(key), F.lit(1).cast("long").alias("warehouse_id"), F.lit(day).cast("timestamp_ntz").alias(ts),
                             F.lit(day).cast("timestamp_ntz").alias("created_date"), F.lit("pending").alias("status"))
    r = warehouse.daily_warehouse_summary(t, AS_OF).first()
    assert int(r.total_available_capacity) == 1000 * big * n**3 and r.total_orders_today == n
    assert int(primitives.j_fanout_product(t, AS_OF).first().joined_rows) == 1000 * n**3


def test_q5_pairs_a_hot_warehouse_in_many_tasks(spark, no_broadcast):
    start = dt.datetime(2001, 5, 1)
    rows = [(w, i, start + dt.timedelta(days=i % 90)) for i in range(900) for w in ((1,) if i % 3 else (2,))]
    t = _tables(spark, warehouses=[(1, "A", "a", "r"), (2, "B", "b", "r"), (3, "C", "c", "r")],
                receipts=[(i, w, d, start, "received") for w, i, d in rows],
                shipments=[(i, w, d, start, "shipped") for w, i, d in rows])
    df = supply_chain.supply_chain(t, AS_OF)
    text = executed(df)
    assert "Union" not in text and sum("SortMergeJoin" in ln and "_old" in ln for ln in text.splitlines()) == 1
    joined = supply_chain.pair_days(*[supply_chain.side_days(t, a, AS_OF, p, d) for a, p, d in (("Receiving", "a", "receive_date"), ("Shipping", "b", "ship_date"))],
                                    F.lit(dt.datetime(2001, 6, 1)).cast("timestamp_ntz"))
    spread = joined.where("warehouse_id = 1").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(spread) > 1


def test_null_keys_are_spread(spark, no_broadcast):
    fact = spark.range(2000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    dim = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("d"))
    got = lookup(fact, dim, "k").collect()
    assert len(got) == 2000
    assert {r.v: r.d for r in got} == {v: (2 * v if v % 3 == 0 else None) for v in range(2000)}
    tasks = lookup(fact, dim, "k").withColumn("t", F.spark_partition_id()).where("k IS NULL").groupBy("t").count().count()
    assert tasks > 1


def test_lookup_widens_no_row(spark, no_broadcast):
    """What spreads NULL keys is part of the join's condition, so a dimension is as large as its own columns."""
    fact = spark.range(50).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    dim = spark.createDataFrame([(3, 30), (3, 31), (6, None), (None, 1)], "k long, d long")
    j = lookup(fact, dim, "k")
    sides = j._jdf.queryExecution().optimizedPlan().children().head().children()
    assert [sides.apply(i).output().size() for i in range(2)] == [2, 2]
    assert j.columns == ["k", "v", "d"] and lookup(fact, dim, "k", "inner").count() == 3
    assert sorted(((r.v, r.d) for r in j.collect() if r.v in (0, 1, 3, 6)), key=str) == [(0, None), (1, None), (3, 30), (3, 31), (6, None)]


def test_v6_shuffles_movements_once_to_group_them(spark, no_broadcast):
    """Ids that are NULL, come twice in a group and in two groups; a location that comes twice multiplies its rows."""
    day, hour = dt.datetime(2001, 5, 1), dt.timedelta(hours=1)
    t = _tables(spark, warehouses=[(1, "A", "a", "r"), (2, "B", "b", "r")], products=[(1, "p", "c", "s", "EA")],
                locations=[(10, 1, "storage", None, 1, 1), (11, 2, "storage", None, 1, 1), (11, 2, "storage", None, 1, 1), (12, None, "storage", None, 1, 1)],
                inventory_movements=[("a", 1, "in", day, 2, None, None, 10), ("a", 1, "in", day + hour, 3, None, None, 10),
                                     ("b", 1, "in", day, 4, None, None, 10), (None, 1, "in", day, 5, None, None, 10),
                                     (None, 1, "out", day, 1, None, 12, 11), ("a", 1, "out", day, 1, None, 12, 11),
                                     ("a", 1, None, None, 7, None, None, None), ("z", None, "in", day, 9, None, None, 10), ("z", 2, "in", day, 9, None, None, 10)])
    df = inventory.product_movement_summary(t)
    text = executed(df)
    assert text.count("Exchange hashpartitioning") == 9 and text.count("Exchange hashpartitioning(product_id#") == 3, text
    got = sorted((tuple(r[c] for c in ("movement_date", "movement_type", "to_location_id", "total_quantity_moved", "movement_count", "warehouse_name"))
                  for r in df.collect()), key=str)
    out = (day, "out", 11, 2, 1, "B")
    assert got == sorted([(day, "in", 10, 14, 2, "A"), out, out, (None, None, None, 7, 1, None)], key=str)


def test_a_changed_bound_shows(spark, monkeypatch):
    """The oracle's bounds are its own: moving one on the Spark side is a mismatch."""
    con = duckdb_con(SF_SMALL)
    sql = oracle.REPORT_SQL["v2_inventory_summary"]()
    build = E.queries()["v2_inventory_summary"]
    assert compare(build(spark, SF_SMALL), con, sql)["match"]
    moved = tuple((((n, op, 12 if b == 10 else b),), label) for ((n, op, b),), label in R.STOCK_STATUS.rules)
    monkeypatch.setattr(R, "STOCK_STATUS", dataclasses.replace(R.STOCK_STATUS, rules=moved))
    assert not compare(build(spark, SF_SMALL), con, sql)["match"]


def test_base_keys(spark):
    t = _tables(spark, orders=[(1, 1, 1, "pending", None, None), (1, 2, 1, "pending", None, None), (None, 2, 1, "pending", None, None)],
                inventory=[(1, 2, 3, 0, None, None), (1, 3, 3, 0, None, None)])
    got = {r.table_name: r for r in S.base_key_stats(t, PRIMARY_KEYS).collect()}
    assert (got["orders"].rows, got["orders"].null_key_rows, got["orders"].duplicate_keys) == (3, 1, 1)
    assert got["inventory"].duplicate_keys == 0 and got["receipts"].rows == 0
