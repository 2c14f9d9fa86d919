"""Typed replicas of all twelve tables: payloads, hand-over, stream with duplicates, late rows and a restart."""
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from depotlens.checks.compare import rows_multiset
from depotlens.sources import feed_fixture as X
from depotlens.sources.fixtures import fixture_tables
from depotlens.sources.tables import SCHEMAS
from depotlens.streaming import replica as R


def ms(df):
    return rows_multiset(df.columns, [tuple(r) for r in df.collect()])


@pytest.fixture(scope="module")
def tables(spark):
    return fixture_tables(spark, SF_SMALL)


def test_payloads_round_trip(spark, tables):
    """Timestamps keep their microseconds, decimals and NULLs their values."""
    rows = tables["orders"].limit(20).withColumn("ship_date", F.expr("timestamp_ntz'2001-02-03 04:05:06.789123'"))
    got = R.typed(R.changes(rows, "orders", "U", F.col("order_id")), "orders")
    assert ms(got.select(*rows.columns)) == ms(rows)
    assert [(f.name, f.dataType) for f in got.drop("lsn", "op").schema] == [(f.name, f.dataType) for f in SCHEMAS["orders"]]


def test_unknown_columns_are_ignored_and_bad_payloads_listed(spark):
    rows = [(1, "customers", "I", None, '{"customer_id": 1, "customer_name": "a", "new_column": [1, 2]}'),
            (2, "customers", "I", None, '{"customer_id": "not a number"}'), (3, "customers", "I", None, "{broken"),
            (4, "customers", "I", None, None), (5, "strange", "I", None, "{}"), (6, None, "I", None, "{}")]
    feed = spark.createDataFrame(rows, R.FEED_SCHEMA)
    assert [(r.customer_id, r.customer_name, r.region, r.lsn) for r in R.typed(feed, "customers").collect()] == [(1, "a", None, 1)]
    assert sorted(r.lsn for r in R.rejected(feed).collect()) == [2, 3, 4, 5, 6]


def test_changes_during_the_copy(spark, scratch):
    """Half of the table is copied before a burst of changes, half after it; then the stream brings the burst."""
    schema = SCHEMAS["customers"]
    before = {k: (k, f"old{k}", "A", "r", "c") for k in range(20)}
    burst = [(11, "U", (2, "new2", "A", "r", "c")), (12, "U", (15, "new15", "A", "r", "c")), (13, "D", before[3]), (14, "D", before[16]),
             (15, "I", (40, "new40", "A", "r", "c")), (16, "I", (4, "again", "A", "r", "c")), (17, "U", (16, "back", "A", "r", "c"))]
    after = dict(before)
    for _, op, row in burst:
        after.pop(row[0], None) if op == "D" else after.update({row[0]: row})
    copy = [before[k] for k in range(10)] + [row for k, row in after.items() if k >= 10]
    rep = R.Replica(spark, os.path.join(scratch, "replica"))
    rep.copy("customers", spark.createDataFrame(copy, schema), started=10, ended=17)
    assert rep.lagging() == ["customers"]
    early = [(9, "U", (5, "stale", "A", "r", "c")), (8, "I", (77, "gone before the copy", "A", "r", "c"))]
    src = os.path.join(scratch, "feed")
    for k, part in enumerate((early + burst[:3], burst[3:])):
        feed = None
        for lsn, op, row in part:
            one = R.changes(spark.createDataFrame([row], schema), "customers", op, F.lit(lsn))
            feed = one if feed is None else feed.unionByName(one)
        feed.coalesce(1).write.parquet(os.path.join(src, f"part={k}"))
        rep.start(src, os.path.join(scratch, "ckpt")).awaitTermination(300)
        assert rep.lagging() == (["customers"] if k == 0 else [])
    assert ms(rep.read("customers")) == ms(spark.createDataFrame(list(after.values()), schema))


def test_stream_with_duplicates_late_rows_and_a_restart(spark, tables, scratch):
    names = ["orders", "order_items", "inventory", "shipment_items"]
    rep = R.Replica(spark, os.path.join(scratch, "replica"))
    for name in names:
        rep.copy(name, X.copy_of(tables, name), X.STARTED, X.ENDED)
    feed = X.feed(tables, names).withColumn("turn", F.pmod(F.xxhash64("lsn"), F.lit(3))).persist()
    src, ckpt = os.path.join(scratch, "feed"), os.path.join(scratch, "ckpt")
    # the turns are by hash: later changes of a key often come first, earlier ones late
    for turn in (2, 0):
        feed.where(F.col("turn") == turn).drop("turn").write.parquet(os.path.join(src, f"turn={turn}"))
    rep.start(src, ckpt).awaitTermination(300)
    feed.where("turn = 0").drop("turn").write.parquet(os.path.join(src, "turn=3"))  # files that are sent twice
    feed.where("turn = 1").drop("turn").write.parquet(os.path.join(src, "turn=1"))
    q = rep.start(src, ckpt)  # restart on the same checkpoint
    q.awaitTermination(300)
    assert q.exception() is None
    for name in names:
        assert ms(rep.read(name)) == ms(tables[name].select(*SCHEMAS[name].names)), name
    stored = sum(rep.changes(name).count() for name in names)
    assert stored == feed.drop("turn").distinct().count()  # no change is stored twice
    assert rep.lagging() == []

    # compaction keeps LSNs and tombstones: changes that come even later are still judged right
    for name in names:
        rep.compact(name)
    rep.start(src, os.path.join(scratch, "ckpt2")).awaitTermination(300)  # a new checkpoint replays everything
    for name in names:
        assert ms(rep.read(name)) == ms(tables[name].select(*SCHEMAS[name].names)), name
    assert set(rep.tables()) == set(names)
    feed.unpersist()


def test_a_batch_that_runs_twice_replaces_itself(spark, scratch):
    """As after the loss of the driver between a batch's write and its commit."""
    rep = R.Replica(spark, os.path.join(scratch, "replica"))
    rep.copy("warehouses", spark.createDataFrame([], SCHEMAS["warehouses"]), 0)
    row = spark.createDataFrame([(1, "w", "l", "r")], SCHEMAS["warehouses"])
    batch = R.changes(row, "warehouses", "I", F.lit(5))
    for _ in range(2):
        rep.store(batch, "stream-0")
    assert rep.changes("warehouses").count() == 1 and ms(rep.read("warehouses")) == ms(row)


def test_publication_filter_and_null_keys(spark, scratch):
    rep = R.Replica(spark, os.path.join(scratch, "replica"))
    start = spark.createDataFrame([(1, "w", "l", "r"), (None, "n", "l", "r")], SCHEMAS["warehouses"])
    rep.copy("warehouses", start, 0)
    gone = R.changes(start.where("warehouse_id = 1"), "warehouses", "D", F.lit(5))
    new = R.changes(start.where("warehouse_id is null").withColumn("region", F.lit("x")), "warehouses", "U", F.lit(6))
    src = os.path.join(scratch, "feed")
    gone.unionByName(new).write.parquet(src)
    rep.start(src, os.path.join(scratch, "ckpt"), publish=("insert", "update")).awaitTermination(300)
    assert sorted((r.warehouse_id or 0, r.region) for r in rep.read("warehouses").collect()) == [(0, "x"), (1, "r")]


def test_copy_and_feed_of_a_table_read_it_once(spark, tables):
    """The histories of all tenths come from one pass over the rows."""
    for name in ("order_items", "inventory_movements", "orders"):
        for df in (X.copy_of(tables, name), X.feed_of(tables, name)):
            assert df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1, name


def test_a_merge_shuffles_copy_and_changes_once(spark, tables):
    """And every payload is parsed once."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("order_items", "orders"):
            rows = X.identified(tables, name)
            feed = spark.createDataFrame([], R.FEED_SCHEMA)
            state = R.merged(R.copied(rows, name, 0), R.typed(feed, name), name, 0)
            text = R.table_of(state, name)._jdf.queryExecution().executedPlan().toString()
            assert text.count("Exchange hashpartitioning") == 2 and text.count("from_json") == 1, text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_counts_run_no_job_and_shuffle_no_wide_row(spark, monkeypatch):
    """The feed of a replica is not stored to be read once, and of an image only its flag meets the other image's."""
    from depotlens.plans import operations
    sc = spark.sparkContext
    sc.setJobGroup("replica counts", "plan only")
    try:
        df = operations.c_replica_counts(spark, SF_SMALL)
        assert list(sc.statusTracker().getJobIdsForGroup("replica counts")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    text = df._jdf.queryExecution().executedPlan().toString()
    sides = [ln for ln in text.splitlines() if "Project [" in ln and ("_s_lsn" in ln or "_c_lsn" in ln)]
    assert sides and not any(f"AS _s_{c}#" in text or f"AS _c_{c}#" in text for s in SCHEMAS.values() for c in s.names)


def test_columns_made_of_images_equal_those_of_the_merge(spark):
    """Odd images: NULL and repeated keys, NULL columns on either side, deletes, changes before the copy."""
    from depotlens.plans import operations
    t = operations._Replicated(spark, SF_SMALL)
    at, late = X.STARTED, X.AFTER
    copy = spark.createDataFrame([(1, 1, "EA"), (1, 2, None), (2, 3, "EA"), (None, 4, "EA"), (3, 5, "CS"), (4, 6, None), (7, 9, "EA")],
                                 "product_id long, size int, unit_of_measure string")
    copy = R.copied(copy.withColumns({c: F.lit("x") for c in ("product_name", "product_category", "sku")}), "products", at)
    rows = [(1, "U", late, "CS"), (2, "U", late, "EA"), (2, "U", late + 1, None), (None, "U", late, None), (3, "D", late, None),
            (4, "U", at - 1, "EA"), (5, "I", late, "EA"), (6, "I", late, None), (6, "D", late + 1, None), (8, "I", None, "EA"), (7, None, late, "CS")]
    changes = spark.createDataFrame(rows, "product_id long, op string, lsn long, unit_of_measure string")
    changes = changes.withColumns({c: F.lit("y") for c in ("product_name", "product_category", "sku")})
    t.images = lambda name: (copy, changes)
    none = F.col("unit_of_measure").isNull() | F.col("product_id").isNull()
    got = sorted(r.flag for r in t.made("products", flag=none).collect())
    assert got == sorted(r.flag for r in t["products"].select(none.alias("flag")).collect())
    assert got == [False, False, False, True, True, True]


@pytest.mark.parametrize("digest", [False, True])
def test_repeated_null_and_empty_text_keys(spark, digest):
    from depotlens.streaming.cdc import apply_changes
    state = spark.createDataFrame([("a", 1, 5, False), ("a", 2, 5, False), ("", 3, 5, False), (None, 4, 5, False), ("b", 6, 5, False)],
                                  "k string, v int, _lsn long, _deleted boolean")
    changes = spark.createDataFrame([("a", 10, 7, "U"), ("a", 11, 6, "U"), (None, 12, 8, "U"), ("c", 13, 1, "I"), ("b", 14, 4, "D"), ("", None, 9, "D")],
                                    "k string, v int, lsn long, op string")
    got = [tuple(r) for r in apply_changes(state, changes, ["k"], digest).select("k", "v", "_lsn", "_deleted").collect()]
    want = [("a", 10, 7, False), ("a", 10, 7, False), ("", None, 9, True), (None, 12, 8, False), ("b", 6, 5, False), ("c", 13, 1, False)]
    assert sorted(got, key=str) == sorted(want, key=str)
