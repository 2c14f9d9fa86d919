"""Report ordering (NULL placement), temp views, CLI dispatch."""
from depotlens import cli
from depotlens.plans import customers, ordering, registry
from depotlens.sources.fixtures import AS_OF


def test_v4_order_puts_null_spenders_first(small_tables):
    rows = ordering.ordered("v4_customer_insights", customers.customer_insights(small_tables)).collect()
    spent = [r["total_spent"] for r in rows]
    n_null = sum(v is None for v in spent)
    assert n_null > 0 and all(v is None for v in spent[:n_null])
    rest = spent[n_null:]
    assert rest == sorted(rest, reverse=True)


def test_q4_order_by_unselected_weekday(small_tables):
    from depotlens.plans.orders import hourly_operations
    rows = ordering.ordered("q4_hourly_operations", hourly_operations(small_tables, AS_OF)).collect()
    days = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
    keys = [(r["warehouse_name"], days.index(r["day_name"]), r["hour_of_day"]) for r in rows]
    assert keys == sorted(keys)


def test_register_views(spark, small_tables):
    names = registry.register_views(spark, small_tables, AS_OF)
    assert len(names) == 17
    assert spark.sql("SELECT count(*) FROM v1_warehouse_performance").first()[0] == 25


def test_views_see_appended_rows(spark, small_tables, scratch):
    from depotlens.sources.tables import load_tables, write_tables
    write_tables(small_tables, scratch, partitions=2)
    views = registry.ReportViews(spark, lambda: load_tables(spark, scratch), AS_OF)
    count = "SELECT count(*) FROM v1_warehouse_performance"
    assert views.sql(count).first()[0] == 25
    more = small_tables["warehouses"].limit(1).selectExpr("warehouse_id + 1000 AS warehouse_id", "warehouse_name", "location_code", "region")
    more.write.mode("append").parquet(scratch + "/warehouses")
    assert views.sql(count).first()[0] == 26


def test_partitions_follow_the_input(spark, small_tables, scratch):
    from depotlens import session
    assert session.partitions_for(0) == 200 and session.partitions_for(10**14) > 700_000
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    small_tables["orders"].write.parquet(scratch + "/o")
    try:
        assert session.size_for(spark, scratch + "/o") == 200 and spark.conf.get(key) == "200"
    finally:
        spark.conf.unset(key)


def test_cli_rejects_unknown_group(capsys):
    assert cli.main(["refresh", "hourly", "--as-of", "2001-07-01", "--fixture-sf", "/nonexistent"]) == 2


def test_cli_report(spark, scratch):
    out = scratch + "/v1"
    assert cli.main(["report", "v1_warehouse_performance", "--as-of", "2001-07-01",
                     "--fixture-sf", "/root/testdata/sf0.001", "--out", out]) == 0
    assert spark.read.parquet(out).count() == 25


def test_cli_layout(spark, scratch):
    out = scratch + "/tables"
    assert cli.main(["layout", "--fixture-sf", "/root/testdata/sf0.001", "--out", out]) == 0
    from depotlens.sources.tables import load_tables
    assert load_tables(spark, out)["warehouses"].count() == 25


def test_scale_defaults_respect_launch_conf(spark):
    from depotlens.session import SCALE_DEFAULTS, apply_scale_defaults
    applied = apply_scale_defaults(spark)
    try:
        assert set(applied) <= set(SCALE_DEFAULTS)
        for k, v in applied.items():
            assert spark.conf.get(k) == v
    finally:  # the test session is shared: put local sizing back
        for k in applied:
            spark.conf.unset(k)


def test_cli_layouts(spark, scratch):
    import os
    import uuid

    from depotlens.sources.bucketed import load_bucketed
    from depotlens.sources.monthly import load_monthly
    base = ["layout", "--fixture-sf", "/root/testdata/sf0.001", "--out"]
    prefix = f"cli_{uuid.uuid4().hex}_"
    assert cli.main([*base, os.path.join(scratch, "b"), "--kind", "bucketed", "--buckets", "3", "--prefix", prefix]) == 0
    assert load_bucketed(spark, os.path.join(scratch, "b"), prefix, 3)["orders"].count() == 1500
    assert cli.main([*base, os.path.join(scratch, "m"), "--kind", "monthly"]) == 0
    assert load_monthly(spark, os.path.join(scratch, "m"))["orders"].count() == 1500


def test_written_tables_expire(spark):
    import os

    from depotlens.session import checkpoint_root, expire_written
    mine, kept = checkpoint_root(spark, "positions", "old"), checkpoint_root(spark, "snapshots-test", "old")
    for path in (mine, kept):
        spark.range(2).write.mode("overwrite").parquet(path)
    os.utime(mine, (1, 1))
    os.utime(kept, (1, 1))
    assert "positions/old" in expire_written(spark, hours=1000)
    assert not os.path.exists(mine) and os.path.exists(kept)
