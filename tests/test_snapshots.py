"""Snapshot key checks, diff, refresh groups with manifest swap, export retention."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from depotlens.operators import snapshots as S
from depotlens.sources.fixtures import AS_OF


def test_duplicate_keys_null_is_distinct(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "b")], "k long, t string")
    got = sorted((r["k"], r["t"], r["n"]) for r in S.duplicate_keys(df, ["k", "t"]).collect())
    assert got == [(1, "a", 2)]
    st = S.key_stats(df, ["k", "t"], "x").first()
    assert (st["rows"], st["null_key_rows"], st["duplicate_keys"]) == (5, 2, 1)
    with pytest.raises(S.DuplicateKeyError):
        S.assert_unique(df, ["k", "t"])


def test_diff_and_apply(spark):
    old = spark.createDataFrame([(1, "x", None), (2, "y", 1.0), (3, "z", 2.0), (4, "w", None)],
                                "k long, a string, b double")
    new = spark.createDataFrame([(1, "x", None), (2, "y", 1.5), (4, "w", None), (5, "v", 0.0)],
                                "k long, a string, b double")
    d = S.diff(old, new, ["k"])
    assert sorted((r["k"], r["op"]) for r in d.collect()) == [(2, "update"), (3, "delete"), (5, "insert")]
    rebuilt = S.apply_diff(old, d, new, ["k"])
    assert sorted(map(tuple, rebuilt.collect()), key=lambda r: r[0]) == \
        sorted(map(tuple, new.collect()), key=lambda r: r[0])


def test_refresh_group_commits_all_members(spark, small_tables, scratch):
    rep = S.refresh(spark, small_tables, "weekly", AS_OF, root=scratch)
    assert list(rep) == ["m3_weekly_order_summary"]
    man = S.read_manifest(scratch)
    assert man["m3_weekly_order_summary"]["as_of"] == AS_OF.isoformat()
    first = S.read_snapshot(spark, "m3_weekly_order_summary", scratch).count()
    rep2 = S.refresh(spark, small_tables, "weekly", AS_OF - dt.timedelta(days=7), root=scratch)
    assert "changes" in rep2["m3_weekly_order_summary"]
    assert S.read_manifest(scratch)["m3_weekly_order_summary"]["version"] != man["m3_weekly_order_summary"]["version"]
    assert first >= 0
    with pytest.raises(ValueError):
        S.refresh(spark, small_tables, "hourly", AS_OF, root=scratch)


def test_failed_member_leaves_manifest(spark, small_tables, scratch, monkeypatch):
    S.refresh(spark, small_tables, "weekly", AS_OF, root=scratch)
    before = S.read_manifest(scratch)
    real = S.builders

    def broken():
        b = dict(real())
        b["m5_product_movement_30days"] = lambda t, d: spark.createDataFrame(
            [(d, 1), (d, 1)], "summary_date date, product_id long")
        return b
    monkeypatch.setattr(S, "builders", broken)
    with pytest.raises(S.DuplicateKeyError):
        S.refresh(spark, small_tables, "daily", AS_OF, root=scratch)
    assert S.read_manifest(scratch) == before  # nothing of the daily group was committed


def test_due_groups():
    assert S.due_groups(dt.datetime(2001, 7, 1, 2, 0)) == ["daily"]
    assert S.due_groups(dt.datetime(2001, 7, 2, 3, 0)) == ["weekly"]      # Monday
    assert S.due_groups(dt.datetime(2001, 7, 1, 4, 0)) == ["monthly"]     # first of month
    assert S.due_groups(dt.datetime(2001, 7, 3, 3, 0)) == []


def test_export_retention(spark, small_tables, scratch):
    from depotlens.plans.warehouse import warehouse_performance
    df = warehouse_performance(small_tables)
    for d in (dt.date(2001, 5, 1), dt.date(2001, 5, 31), dt.date(2001, 6, 1)):
        S.export_snapshot(spark, df, scratch, "v1", d)
    S.export_snapshot(spark, df, scratch, "v1", AS_OF)
    parts = sorted(os.listdir(scratch))
    assert parts == ["dt=2001-06-01", "dt=2001-07-01"]
    assert S.expired(["dt=2001-05-31", "dt=2001-06-01", "x"], AS_OF) == ["dt=2001-05-31"]


def test_export_all_reports(spark, small_tables, scratch):
    paths = S.export_reports(spark, small_tables, AS_OF, scratch)
    assert len(paths) == 17
    assert sorted(os.listdir(os.path.join(scratch, "dt=2001-07-01"))) == sorted(os.path.basename(p) for p in paths)
    assert spark.read.parquet(paths[0]).count() == 25


def test_prune_versions_keeps_committed(spark, small_tables, scratch):
    for d in (AS_OF - dt.timedelta(days=14), AS_OF - dt.timedelta(days=7), AS_OF):
        S.refresh(spark, small_tables, "weekly", d, root=scratch)
    gone = S.prune_versions(spark, scratch, keep=1)
    assert len(gone) == 2
    assert S.read_snapshot(spark, "m3_weekly_order_summary", scratch).count() >= 0


def test_session_is_pinned_to_utc(spark):
    from depotlens.sources.fixtures import fixture_tables
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    fixture_tables(spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


def test_overlapping_refreshes_lose_nothing(spark, small_tables, scratch, monkeypatch):
    """A weekly refresh that commits while the daily one runs stays committed; the same group conflicts."""
    from depotlens.sources.fixtures import AS_OF
    S.refresh(spark, small_tables, "daily", AS_OF, scratch)
    real = S.materialize
    state = {"done": False}

    def slow(spark_, df, name, root=None, key=None):
        out = real(spark_, df, name, root, key)
        if not state["done"]:
            state["done"] = True
            S.refresh(spark_, small_tables, "weekly", AS_OF, scratch)
        return out
    monkeypatch.setattr(S, "materialize", slow)
    S.refresh(spark, small_tables, "daily", AS_OF, scratch)
    assert set(S.read_manifest(scratch, spark)) == set(S.GROUPS["daily"] + S.GROUPS["weekly"])
    state["done"] = False

    def same(spark_, df, name, root=None, key=None):
        out = real(spark_, df, name, root, key)
        if not state["done"]:
            state["done"] = True
            S.refresh(spark_, small_tables, "daily", AS_OF, scratch)
        return out
    monkeypatch.setattr(S, "materialize", same)
    try:
        S.refresh(spark, small_tables, "daily", AS_OF, scratch)
        raise AssertionError("no conflict")
    except S.RefreshConflict:
        pass


def test_one_grouping_checks_keys_and_counts_changes(spark):
    schema = "k int, t string, v int"
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3), (None, "n", 1)], schema)
    new = spark.createDataFrame([(1, "a", 1), (2, "b", 5), (4, "d", 4), (None, "n", 1), (None, "m", 1), (None, "m", 1)], schema)
    assert S.check_and_diff(old, new, ["k", "t"]) == {"rows": 6, "duplicates": 0, "insert": 2, "delete": 1, "update": 1}
    want = {r["op"]: r["count"] for r in S.diff(old, new.dropDuplicates(), ["k", "t"]).groupBy("op").count().collect()}
    assert want == {"insert": 2, "delete": 1, "update": 1}
    twice = new.unionByName(new.where("k = 4"))
    assert S.check_and_diff(None, twice, ["k", "t"])["duplicates"] == 1
    assert S.check_and_diff(None, new.limit(0), ["k", "t"]) == {"rows": 0, "duplicates": 0, "insert": 0, "delete": 0, "update": 0}


def test_refresh_refuses_duplicate_keys(spark, small_tables, scratch):
    twice = dict(small_tables)
    for name in ("warehouses", "orders", "order_items"):
        twice[name] = small_tables[name]
    twice["warehouses"] = small_tables["warehouses"].unionByName(small_tables["warehouses"].withColumn("warehouse_name", F.lit("again")))
    with pytest.raises(S.DuplicateKeyError):
        S.refresh(spark, twice, "weekly", AS_OF, scratch)
    assert S.read_manifest(scratch, spark) == {}


def test_refresh_reads_each_snapshot_once(spark, small_tables, scratch, monkeypatch):
    """Beside the write one job per member: no key check, count or diff of its own."""
    S.refresh(spark, small_tables, "weekly", AS_OF, scratch)
    calls = []
    for name in ("duplicate_keys", "assert_unique", "diff"):
        monkeypatch.setattr(S, name, lambda *a, n=name, **k: calls.append(n))
    monkeypatch.setattr(S, "check_and_diff", lambda *a, f=S.check_and_diff: (calls.append("check_and_diff"), f(*a))[1])
    rep = S.refresh(spark, small_tables, "weekly", AS_OF, scratch)
    assert calls == ["check_and_diff"] and rep["m3_weekly_order_summary"]["changes"] == {}


def test_export_commits_whole_runs(spark, scratch, monkeypatch):
    day = dt.date(2001, 7, 1)
    first = S.export_snapshot(spark, spark.range(3), scratch, "x", day)
    broken = spark.range(5).select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception):
        S.export_snapshot(spark, broken, scratch, "x", day)
    assert S.read_export(spark, scratch, "x", day).count() == 3  # the old one is still there
    real = S.fsio.write_text_atomic
    monkeypatch.setattr(S.fsio, "write_text_atomic", lambda *a: (_ for _ in ()).throw(RuntimeError("lost before the commit")))
    with pytest.raises(RuntimeError):
        S.export_snapshot(spark, spark.range(7), scratch, "x", day)
    monkeypatch.setattr(S.fsio, "write_text_atomic", real)
    assert S.read_export(spark, scratch, "x", day).count() == 3
    second = S.export_snapshot(spark, spark.range(4), scratch, "x", day)
    assert second != first and S.read_export(spark, scratch, "x", day).count() == 4
    assert spark.read.parquet(first).count() == 3  # a reader of the run before is not cut off
    with pytest.raises(KeyError):
        S.read_export(spark, scratch, "y", day)


def test_due_column_agrees_with_due_groups(spark):
    hours = [dt.datetime(2001, 6, 28) + dt.timedelta(hours=h) for h in range(24 * 8)]
    df = spark.createDataFrame([(h,) for h in hours], "h timestamp_ntz").select("h", S.due(F.col("h")).alias("groups"))
    assert all(r.groups == S.due_groups(r.h) for r in df.collect())
