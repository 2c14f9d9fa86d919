"""Co-bucketed layout, spread clustering, bitmaps, global positions, outer joins with a hot many side."""
import contextlib
import datetime as dt
import io
import re
import uuid

import pytest
from pyspark.sql import functions as F

from depotlens.checks.compare import rows_multiset
from depotlens.operators import bitmaps as B
from depotlens.operators.joins import left_join_many
from depotlens.plans import customers, orders, ordering, warehouse
from depotlens.session import SCALE_DEFAULTS
from depotlens.sources import bucketed, monthly
from depotlens.sources.fixtures import AS_OF
from depotlens.sources.tables import SCHEMAS, load_tables, write_tables


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def ms(df):
    return rows_multiset(df.columns, [tuple(r) for r in df.collect()])


@pytest.fixture(scope="module")
def buckets(spark, small_tables, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("bucketed"))
    return root, bucketed.write_bucketed(small_tables, root, f"t_{uuid.uuid4().hex}_", 4)


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


REPORTS = {
    "v3": (orders.order_performance, ()), "m3": (orders.weekly_order_summary, (AS_OF,)),
    "v4": (customers.customer_insights, ()), "m4": (customers.customer_lifetime_value, (AS_OF,)),
    "q3": (customers.customer_rfm, (AS_OF,)), "v5": (warehouse.shipping_receiving_performance, ()),
    "m6": (warehouse.daily_shipping_receiving, (AS_OF,)),
}


@pytest.mark.parametrize("name", REPORTS)
def test_no_exchange_on_parent_ids(spark, small_tables, buckets, no_broadcast, name):
    """Roll-ups of lines and their joins to headers read both sides bucket by bucket."""
    fn, args = REPORTS[name]
    on_parent = re.compile(r"hashpartitioning\((order_id|shipment_id|receipt_id)#")
    got = fn(buckets[1], *args)
    assert not on_parent.search(plan(got))
    assert on_parent.search(plan(fn(small_tables, *args)))  # the same report without the layout
    assert ms(got) == ms(fn(small_tables, *args))


def test_bucketed_tables_register_again(spark, small_tables, buckets):
    """A session whose catalogue does not know the tables finds them by their folder."""
    t = bucketed.load_bucketed(spark, buckets[0], f"again_{uuid.uuid4().hex}_", 4)
    for name in ("orders", "order_items", "warehouses"):
        assert ms(t[name]) == ms(small_tables[name])
    assert "Bucketed: true" in plan(t["order_items"].groupBy("order_id").count())


def test_lines_without_a_parent_are_kept_apart(spark, scratch):
    rows = [("a", 1, 1, 1, 1, 0, None), ("b", None, 1, 1, 1, 0, None)]
    lines = spark.createDataFrame(rows, SCHEMAS["order_items"])
    t = bucketed.write_bucketed({"order_items": lines}, scratch, f"o_{uuid.uuid4().hex}_", 2, ["order_items"])
    assert [r.order_item_id for r in t["order_items"].collect()] == ["a"]
    assert [r.order_item_id for r in bucketed.orphans(spark, scratch, "order_items").collect()] == ["b"]


MONTHLY = {"m3": (orders.weekly_order_summary, 1), "q1": (orders.warehouse_monthly_ranking, 13),
           "q4": (orders.hourly_operations, 3), "m6": (warehouse.daily_shipping_receiving, 2)}


def scans(node) -> list[tuple[str, int]]:
    """(table folder, files read) of every scan of an executed plan."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return scans(node.finalPhysicalPlan())
    if kind.endswith("QueryStageExec"):
        return scans(node.plan())
    if kind == "FileSourceScanExec":
        return [(re.search(r"/(\w+)$", node.relation().location().rootPaths().head().toString())[1], node.metrics().apply("numFiles").value())]
    return [x for k in range(node.children().size()) for x in scans(node.children().apply(k))]


@pytest.fixture(scope="module")
def monthly_tables(spark, small_tables, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("monthly"))
    monthly.write_monthly(small_tables, root, partitions=4)
    return monthly.load_monthly(spark, root)


@pytest.mark.parametrize("name", MONTHLY)
def test_lines_are_pruned_at_run_time(spark, small_tables, monthly_tables, no_broadcast, name):
    """Without any broadcast: partitions of the lines by the headers' months, lines by a Bloom filter of their ids."""
    conf = {k: v for k, v in SCALE_DEFAULTS.items() if "optimizer" in k} | {
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}  # these tables are small
    before = {k: spark.conf.get(k) for k in conf}
    fn, months = MONTHLY[name]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = fn(monthly_tables, AS_OF)
        text = plan(got)
        assert "dynamicpruning" in text and "might_contain" in text
        assert ms(got) == ms(fn(small_tables, AS_OF))
        got.collect()
        read = scans(got._jdf.queryExecution().executedPlan())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    lines = [(t, n) for t, n in read if t.endswith("_items")]
    assert lines
    for table, files in lines:
        whole = len(monthly_tables[table].inputFiles())
        assert files <= 4 * months < whole  # a month is in at most four files here


def test_monthly_layout_holds_every_row(small_tables, monthly_tables):
    for name, schema in SCHEMAS.items():
        assert ms(monthly_tables[name].select(*schema.names)) == ms(small_tables[name]), name
    assert ms(orders.order_performance(monthly_tables)) == ms(orders.order_performance(small_tables))


def test_null_and_hot_clustering_values_are_spread(spark, scratch):
    d = dt.datetime(2001, 1, 1)
    ship = [(i, 1, None if i % 3 == 0 else d + dt.timedelta(days=i % 200), d, "shipped") for i in range(6000)]
    items = [(f"i{i}", 7 if i % 3 == 0 else i, 1, 1, 1, 0, None) for i in range(6000)]
    empty = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
    tables = empty | {"shipments": spark.createDataFrame(ship, SCHEMAS["shipments"]), "order_items": spark.createDataFrame(items, SCHEMAS["order_items"])}
    write_tables(tables, scratch, partitions=8)
    t = load_tables(spark, scratch)
    for name, hot in (("shipments", F.col("ship_date").isNull()), ("order_items", F.col("order_id") == 7)):
        sizes = [r["count"] for r in t[name].groupBy(F.input_file_name()).count().collect()]
        assert max(sizes) < 2 * 6000 / 8
        assert t[name].where(hot).select(F.input_file_name()).distinct().count() >= 2


def test_outer_join_with_a_hot_many_side(spark, no_broadcast):
    """A third of all rows on one key: the join is split, and NULL keys and rows without a match are right."""
    one = spark.createDataFrame([(k, f"n{k}") for k in range(50)] + [(None, "none")], "k long, name string")
    many = spark.range(90000).select(F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 1000 == 1, None)
                                     .otherwise(F.col("id") % 40).cast("long").alias("k"), "id", F.repeat(F.lit("x"), 50).alias("pad"))
    want = one.join(many, "k", "left")
    got = left_join_many(one, many, "k")
    assert got.columns == want.columns
    agg = lambda df: ms(df.groupBy("k", "name").agg(F.count("id").alias("n"), F.sum("id").alias("s")))
    assert agg(got) == agg(want)
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = left_join_many(one, many.repartition(6), "k")
        df.collect()
        assert "isSkew=true" in df._jdf.queryExecution().executedPlan().toString() or "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_bitmaps_add_up(spark):
    rows = [(d, w, c) for d in range(14) for w in (1, 2) for c in (d, d * 3000, d * 40000, -d, None)]
    df = spark.createDataFrame(rows, "d int, w int, c long").repartition(5)
    days = B.bitmaps(df, ["d", "w"], "c")
    week = (F.col("d") / 7).cast("int").alias("week")
    got = {(r.week, r.w): r.n for r in B.cardinality(B.merge(days, [week, "w"]), "n").collect()}
    assert got == {(k, w): len({c for d, w2, c in rows if d // 7 == k and w2 == w and c is not None}) for k in (0, 1) for w in (1, 2)}
    assert {r.n for r in B.cardinality(days, "n").where("d = 0").collect()} == {1}
    assert B.cardinality(B.bitmaps(df.limit(0), ["d"], "c"), "n").collect() == []


def test_positions_of_many_partitions(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("a"), F.when(F.col("id") % 9 != 0, F.col("id")).alias("b")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordering.with_position(df, [F.col("b").desc_nulls_first(), F.col("a").asc()]).orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r.position for r in got] == list(range(1, 5001))
    rows = sorted(((r.b is not None, -(r.b or 0), r.a) for r in df.collect()))
    assert [(r.b is not None, -(r.b or 0), r.a) for r in got] == rows
    assert ordering.with_position(df.limit(0), [F.col("a").asc()]).collect() == []


def test_no_window_over_all_rows_for_positions(spark, small_tables):
    df = ordering.positions("v4_customer_insights", customers.customer_insights(small_tables))
    assert "Window" not in plan(df)


def test_sparse_bitmaps_hold_no_more_than_their_rows(spark):
    """Ids far apart store a word each, and words are hashed, not sorted."""
    df = spark.createDataFrame([(d, c * 100_000) for d in range(3) for c in range(50)], "d int, c long")
    days = B.bitmaps(df, ["d"], "c")
    assert dict(days.dtypes)[B.BITS] == "bigint" and days.count() == 150
    assert "SortAggregate" not in plan(B.cardinality(B.merge(days, ["d"]), "n"))
    assert [r.n for r in B.cardinality(days, "n").collect()] == [50] * 3


def test_buckets_grow_with_the_input():
    """A task sorts one bucket, which holds no more than a fixed part of the input."""
    assert bucketed.buckets_for(0) == 16
    for size in (1 << 30, 6 << 30):
        assert size / bucketed.buckets_for(size) <= bucketed.BUCKET_BYTES


def test_lines_are_filtered_before_their_shuffle(spark, scratch):
    """Without settings of the launch, too: a week's orders leave few of all lines to shuffle."""
    from depotlens.operators.joins import restrict_to_keys
    from depotlens.session import PRUNING
    own = {k: spark.conf.get(k) for k in (*PRUNING, "spark.sql.autoBroadcastJoinThreshold")}
    for k, (default, _) in PRUNING.items():
        spark.conf.set(k, default)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # text that does not compress: a table over the setting's 64 MB
        spark.range(0, 600_000, 1, 4).selectExpr("id", "concat(sha2(cast(id as string), 512), sha2(cast(-id as string), 256)) as t").write.parquet(f"{scratch}/lines")
        spark.range(0, 600_000, 1, 4).selectExpr("id", "id % 1000 as day").write.parquet(f"{scratch}/heads")
        kept = restrict_to_keys(spark.read.parquet(f"{scratch}/lines"), spark.read.parquet(f"{scratch}/heads").where("day < 3"), "id")
        assert "might_contain" in plan(kept) and kept.count() == 1800
        spark.conf.set(next(iter(PRUNING)), "5GB")  # what the user set stays
        restrict_to_keys(kept, kept, "id")
        assert spark.conf.get(next(iter(PRUNING))) == "5GB"
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)
