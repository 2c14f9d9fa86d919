"""C6 as a stream: V3 kept current from order changes equals a full recompute."""
import datetime as dt
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from depotlens.checks.compare import rows_multiset
from depotlens.plans.orders import order_performance
from depotlens.sources.fixtures import fixture_tables
from depotlens.streaming.incremental import IncrementalV3, start_incremental_v3_stream

CUT = dt.datetime(1998, 1, 1)


def _ms(df):
    return rows_multiset(df.columns, [tuple(r) for r in df.collect()])


def test_stream_keeps_v3_current(spark, scratch):
    t = fixture_tables(spark, SF_SMALL)
    orders = t["orders"]
    cut = F.lit(CUT).cast("timestamp_ntz")
    job = IncrementalV3(spark, os.path.join(scratch, "job"), t["warehouses"], buckets=8)
    lines = t["order_items"].dropDuplicates(["order_item_id"])
    late = F.col("order_id") % 6 == 0  # of these orders the lines come by the stream
    job.initialize(orders.where(F.col("order_date") < cut), lines.where(~late))

    cols = orders.columns
    later = orders.where(F.col("order_date") >= cut)
    inserts = later.select(*cols, (F.col("order_id") + 1_000_000).alias("lsn"), F.lit("I").alias("op"))
    early = orders.where(F.col("order_date") < cut)
    # updates: status flips and some orders move by 3 days (old and new day both change)
    updates = early.where(F.col("order_id") % 5 == 1).select(
        "order_id", "customer_id", "warehouse_id", F.lit("cancelled").alias("status"),
        F.when(F.col("order_id") % 2 == 1, F.col("order_date") + F.expr("INTERVAL 3 DAYS"))
         .otherwise(F.col("order_date")).alias("order_date"),
        "ship_date", (F.col("order_id") + 2_000_000).alias("lsn"), F.lit("U").alias("op"))
    deletes = early.where(F.col("order_id") % 7 == 2).select(
        *cols, (F.col("order_id") + 3_000_000).alias("lsn"), F.lit("D").alias("op"))
    src = os.path.join(scratch, "changes")
    inserts.write.parquet(os.path.join(src, "b=0"))
    updates.unionByName(deletes).write.parquet(os.path.join(src, "b=1"))

    line_src = os.path.join(scratch, "line_changes")
    change = lambda df, op, lsn: df.withColumn("lsn", F.lit(lsn).cast("long")).withColumn("op", F.lit(op))
    change(lines.where(late), "I", 10).write.parquet(os.path.join(line_src, "b=0"))
    more = lines.where(F.col("order_id") % 8 == 1).withColumn("quantity_shipped", F.col("quantity_shipped") + 5)
    gone = lines.where(F.col("order_id") % 8 == 3)
    moved = lines.where(F.col("order_id") % 8 == 5).withColumn("order_id", F.col("order_id") + 8)
    for k, (df, op) in enumerate(((more, "U"), (gone, "D"), (moved, "U"))):
        change(df, op, 20 + k).write.parquet(os.path.join(line_src, f"b={k + 1}"))
    for _ in range(2):  # the second run has a new checkpoint and replays everything
        q = start_incremental_v3_stream(spark, src, line_src, job, os.path.join(scratch, f"ckpt{_}"))
        q.awaitTermination(300)
        assert q.exception() is None

    final = (early.join(updates.select("order_id"), "order_id", "left_anti")
             .join(deletes.select("order_id"), "order_id", "left_anti")
             .unionByName(updates.join(deletes.select("order_id"), "order_id", "left_anti").select(*cols))
             .unionByName(later))  # a delete (higher LSN) wins over an update of the same order
    assert _ms(job.read_orders().select(*cols)) == _ms(final.select(*cols))
    left = lines
    for df in (more, gone, moved):
        left = left.join(df.select("order_item_id"), "order_item_id", "left_anti")
    left = left.unionByName(more).unionByName(moved)
    assert _ms(job.read_lines().select(*lines.columns)) == _ms(left.select(*lines.columns))
    want = order_performance({"orders": final, "order_items": left, "warehouses": t["warehouses"]})
    got = job.read_v3()
    assert sorted(got.columns) == sorted(want.columns)
    assert _ms(got.select(*want.columns)) == _ms(want)
    assert job.manifest()["epoch"] >= 0


def test_a_batch_reads_only_the_buckets_of_its_orders(spark, scratch, monkeypatch):
    """Signed deltas: neither table nor V3 is read as a whole, and the result is the full report's."""
    from depotlens.streaming.cdc import StateStore
    t = fixture_tables(spark, SF_SMALL)
    lines = t["order_items"].dropDuplicates(["order_item_id"])
    job = IncrementalV3(spark, os.path.join(scratch, "job"), t["warehouses"], buckets=64)
    job.initialize(t["orders"], lines)
    months = len(job.manifest()["v3"])
    batch = t["orders"].where("order_id between 100 and 109").withColumn("status", F.lit("cancelled"))
    changes = batch.withColumn("lsn", F.lit(5).cast("long")).withColumn("op", F.lit("U"))
    some = lines.where("order_id between 104 and 107").withColumn("quantity_ordered", F.lit(7).cast("long"))
    line_changes = some.withColumn("lsn", F.lit(6).cast("long")).withColumn("op", F.lit("U"))
    own = set(job.orders.touched_buckets(batch))
    read, real = [], StateStore._read_paths
    monkeypatch.setattr(StateStore, "_read_paths", lambda self, paths: (read.append((self.section, paths)), real(self, paths))[1])
    kept = []
    monkeypatch.setattr(job, "_kept", lambda m, only=None, f=job._kept: (kept.append(only), f(m, only))[1])
    before = job.manifest()
    job.apply(changes, line_changes, 0)
    monkeypatch.undo()
    for section, paths in read:
        if section != "line_owners":
            assert {int(p.rsplit("=", 1)[1]) for p in paths} <= own and len(paths) <= 10
            assert all(len(spark.read.parquet(p).inputFiles()) == 1 for p in paths)
    assert {s for s, _ in read} == {"orders", "order_items", "line_owners"}
    assert len(kept) == 1 and 0 < len(kept[0]) <= 10 < months
    after = job.manifest()
    assert sum(after["order_items"][b] != before["order_items"][b] for b in after["order_items"]) <= len(own)
    orders = t["orders"].join(batch.select("order_id"), "order_id", "left_anti").unionByName(batch)
    rest = lines.join(some.select("order_item_id"), "order_item_id", "left_anti").unionByName(some)
    want = order_performance({"orders": orders, "order_items": rest, "warehouses": t["warehouses"]})
    assert _ms(job.read_v3().select(*want.columns)) == _ms(want)


def test_nulls_in_the_figures(spark, scratch):
    """A sum without a value is NULL again once its last value is gone; days and groups come and go."""
    from depotlens.sources.tables import SCHEMAS
    d, none = dt.datetime(2001, 5, 1, 10), None
    orders = spark.createDataFrame([(1, 5, 1, "completed", d, none), (2, 5, none, "pending", none, none), (3, none, 1, none, d, d)], SCHEMAS["orders"])
    from decimal import Decimal as D
    lines = spark.createDataFrame([("a", 1, 1, 2, none, none, D("1.50")), ("b", 3, 1, none, none, none, none), ("c", none, 1, 1, 1, 1, D("1"))],
                                  SCHEMAS["order_items"])
    w = spark.createDataFrame([(1, "w", "l", "r")], SCHEMAS["warehouses"])
    job = IncrementalV3(spark, os.path.join(scratch, "job"), w, buckets=4)
    job.initialize(orders, lines)
    check = lambda o, x: _ms(job.read_v3()) == _ms(order_performance({"orders": o, "order_items": x, "warehouses": w}))
    assert check(orders, lines)
    change = lambda df, op, lsn: df.withColumn("lsn", F.lit(lsn).cast("long")).withColumn("op", F.lit(op))
    job.apply(orders.limit(0).select("*", F.lit(0).cast("long").alias("lsn"), F.lit("U").alias("op")), change(lines.where("order_item_id = 'a'"), "D", 3), 0)
    assert check(orders, lines.where("order_item_id <> 'a'"))
    job.apply(change(orders.where("order_id = 2"), "D", 4), None, 1)
    assert check(orders.where("order_id <> 2"), lines.where("order_item_id <> 'a'")) and "none" not in job.manifest()["v3"]


def test_a_batch_writes_its_own_rows_and_a_replay_none(spark, scratch, monkeypatch):
    """a batch adds a layer of its rows to the buckets; repeated keys, lines that move and layers made one give the full report."""
    from depotlens.sources.tables import SCHEMAS
    from depotlens.streaming import incremental
    from decimal import Decimal as D
    monkeypatch.setattr(incremental, "MAX_LAYERS", 2)
    d = dt.datetime(2001, 5, 1, 10)
    orders = spark.createDataFrame([(i, 5, i % 3, "pending", d + dt.timedelta(days=i % 4), None) for i in [*range(40), 7]], SCHEMAS["orders"])
    lines = spark.createDataFrame([(f"l{i}", i % 40, 1, i, 1, None, D("1.50")) for i in [*range(120), 9, 9]], SCHEMAS["order_items"])
    w = spark.createDataFrame([(1, "w", "l", "r")], SCHEMAS["warehouses"])
    job = IncrementalV3(spark, os.path.join(scratch, "job"), w, buckets=2)
    job.initialize(orders, lines)
    change = lambda df, op, lsn: df.withColumn("lsn", F.lit(lsn).cast("long")).withColumn("op", F.lit(op))
    sections = ("orders", "order_items", "line_owners", "v3")
    for k in (1, 2, 3):
        more = orders.where(f"order_id = {k}").withColumn("status", F.lit("completed"))
        moved = lines.where("order_item_id in ('l9', 'l50')").withColumn("order_id", F.lit(k).cast("long"))
        before = job.manifest()
        job.apply(change(more, "U", 10 + k), change(moved, "U", 10 + k), k)
        after = job.manifest()
        if k == 1:
            new = [p for b in after["order_items"] for p in after["order_items"][b] if p not in before["order_items"].get(b, [])]
            assert spark.read.parquet(*new).count() == 4 + 4  # the three copies of l9 and l50, and where they were
            assert all(set(before["order_items"][b]) <= set(after["order_items"][b]) for b in before["order_items"])
    now = orders.withColumn("status", F.expr("if(order_id between 1 and 3, 'completed', status)"))
    at = lines.withColumn("order_id", F.expr("if(order_item_id in ('l9', 'l50'), 3L, order_id)"))
    check = lambda: _ms(job.read_v3()) == _ms(order_performance({"orders": now, "order_items": at, "warehouses": w}))
    assert check() and _ms(job.read_lines().select(*lines.columns)) == _ms(at) and _ms(job.read_orders().select(*orders.columns)) == _ms(now)
    assert all(len(p) <= 2 for s in sections[:3] for p in job.manifest()[s].values())
    before = job.manifest()
    job.apply(change(more, "U", 10 + k), change(moved, "U", 10 + k), 99)
    assert all(job.manifest()[s] == before[s] for s in sections) and check()
    job.apply(change(more, "D", 50), change(at.where("order_item_id = 'l9'"), "D", 51), 100)
    now, at = now.where(f"order_id <> {k}"), at.where("order_item_id <> 'l9'")
    assert check()
