"""Change apply: split invariance, replays, deletes, streaming wrapper, incremental V3."""
import datetime as dt
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from depotlens.checks.compare import rows_multiset
from depotlens.sources.fixtures import fixture_tables
from depotlens.streaming import cdc

SCHEMA = cdc.CHANGE_SCHEMA
T = dt.datetime(2024, 1, 1)


def feed(spark, rows):
    return spark.createDataFrame([(lsn, "orders.orders", k, op, v, T) for lsn, k, op, v in rows], SCHEMA)


def state_rows(state):
    return sorted((r["key"], r["value"], r["_lsn"]) for r in cdc.visible(state).collect())


def test_insert_update_delete_in_one_batch(spark):
    f = feed(spark, [(1, 10, "I", 1.0), (2, 10, "U", 2.0), (3, 10, "D", None), (4, 11, "I", 5.0),
                     (6, 11, "U", 7.0), (5, 11, "U", 6.0)])  # out-of-order LSN inside the batch
    s = cdc.apply_changes(cdc.empty_state(spark), f)
    assert state_rows(s) == [(11, 7.0, 6)]


def test_split_and_replay_equal_one_batch(spark):
    rows = [(i, i % 4, "IUUD"[i % 4], float(i)) for i in range(1, 40)]
    whole = cdc.apply_changes(cdc.empty_state(spark), feed(spark, rows))
    s = cdc.empty_state(spark)
    parts = [rows[:13], rows[13:27], rows[13:27], rows[27:], rows[:13]]  # replay + late old batch
    for p in parts:
        s = cdc.apply_changes(s, feed(spark, p))
    assert state_rows(s) == state_rows(whole)


def test_tombstone_blocks_resurrection(spark):
    s = cdc.apply_changes(cdc.empty_state(spark), feed(spark, [(1, 1, "I", 1.0), (2, 1, "D", None)]))
    s = cdc.apply_changes(s, feed(spark, [(1, 1, "I", 1.0)]))  # re-delivered insert
    assert state_rows(s) == []


def test_initial_copy_then_changes(spark):
    base = cdc.initial_copy(spark.createDataFrame([("orders.orders", 1, 9.0, T), ("orders.orders", 2, 8.0, T)],
                                                  "table string, key long, value double, ts timestamp_ntz"))
    s = cdc.apply_changes(base, feed(spark, [(5, 2, "U", 1.0), (6, 3, "I", 3.0)]))
    assert state_rows(s) == [(1, 9.0, 0), (2, 1.0, 5), (3, 3.0, 6)]


def test_publication_filters(spark):
    f = spark.createDataFrame([(1, "orders.orders", 1, "I", 1.0, T), (2, "staging.x", 1, "I", 1.0, T),
                               (3, "inventory.inventory", 2, "D", None, T)], SCHEMA)
    assert [r.lsn for r in cdc.select_tables(f).orderBy("lsn").collect()] == [1, 3]
    assert [r.lsn for r in cdc.select_tables(f, tables=["staging.x"]).collect()] == [2]
    assert [r.lsn for r in cdc.filter_ops(f, ("insert",)).orderBy("lsn").collect()] == [1, 2]


def test_streaming_apply_matches_batch(spark, scratch):
    src = os.path.join(scratch, "changes")
    rows = [(i, i % 5, "IUUUD"[i % 5], float(i)) for i in range(1, 60)]
    for n, part in enumerate([rows[:20], rows[20:45], rows[45:]]):
        feed(spark, part).write.parquet(os.path.join(src, f"batch={n}"))
    q = cdc.start_apply_stream(spark, src, os.path.join(scratch, "state"), os.path.join(scratch, "ckpt"), buckets=4)
    q.awaitTermination(120)
    assert cdc.progress_frame(spark, q).count() >= 1
    got = cdc.StateStore(spark, os.path.join(scratch, "state"), 4).read()
    want = cdc.apply_changes(cdc.empty_state(spark), feed(spark, rows))
    assert state_rows(got) == state_rows(want)
    # a restart with nothing new leaves the state version alone
    v = cdc.StateStore(spark, os.path.join(scratch, "state")).current_version()
    q2 = cdc.start_apply_stream(spark, src, os.path.join(scratch, "state"), os.path.join(scratch, "ckpt"), buckets=4)
    q2.awaitTermination(120)
    assert cdc.StateStore(spark, os.path.join(scratch, "state")).current_version() == v


def test_incremental_v3_equals_full(spark):
    from depotlens.plans.orders import order_performance
    t = fixture_tables(spark, SF_SMALL)
    cut = dt.datetime(1998, 1, 1)
    before = {"orders": t["orders"].where(F.col("order_date") < F.lit(cut).cast("timestamp_ntz")),
              "order_items": t["order_items"], "warehouses": t["warehouses"]}
    changed = t["orders"].where(F.col("order_date") >= F.lit(cut).cast("timestamp_ntz"))
    inc = cdc.incremental_order_performance(t, order_performance(before), changed)
    full = order_performance(t)
    assert rows_multiset(inc.columns, inc.collect()) == rows_multiset(full.columns, full.collect())


def test_dml_counts_with_like(spark):
    f = spark.createDataFrame([(1, "orders.orders", 1, "I", 1.0, T), (2, "orders.orders", 1, "D", None, T),
                               (3, "staging.x", 2, "U", 1.0, T)], SCHEMA)
    rows = {(r.schemaname, r.tablename): (r.inserts, r.updates, r.deletes, r.live_tuples)
            for r in cdc.table_dml_counts(f, schema_like="%ord%").collect()}
    assert rows == {("orders", "orders"): (1, 0, 1, 0)}


def test_bucketed_store_rewrites_only_touched_buckets(spark, scratch):
    store = cdc.StateStore(spark, scratch, buckets=8)
    rows = [(i, i, "I", float(i)) for i in range(1, 41)]
    assert store.apply(feed(spark, rows), 0)
    first = dict(store.manifest()["buckets"])
    assert len(first) == 8
    assert store.apply(feed(spark, [(100, 3, "U", 0.5), (101, 4, "D", None)]), 1)
    second = store.manifest()["buckets"]
    changed = {b for b in second if second[b] != first[b]}
    assert 1 <= len(changed) <= 2
    store.apply(feed(spark, [(100, 3, "U", 0.5), (101, 4, "D", None)]), 1)      # replay: nothing is newer
    store.apply(feed(spark, [(102, 5, "D", None)]), 1)      # another batch of the same number is not skipped
    want = cdc.apply_changes(cdc.empty_state(spark),
                             feed(spark, rows + [(100, 3, "U", 0.5), (101, 4, "D", None), (102, 5, "D", None)]))
    assert state_rows(store.read()) == state_rows(want)


def test_a_new_checkpoint_on_old_state_loses_nothing(spark, scratch):
    """Batch numbers start again at 0; changes are applied by their LSN."""
    import os
    src, root = os.path.join(scratch, "src"), os.path.join(scratch, "state")
    feed(spark, [(1, 1, "I", 1.0)]).write.parquet(os.path.join(src, "a=0"))
    cdc.start_apply_stream(spark, src, root, os.path.join(scratch, "c1"), buckets=4).awaitTermination(120)
    feed(spark, [(2, 1, "U", 2.0), (3, 2, "I", 3.0)]).write.parquet(os.path.join(src, "a=1"))
    cdc.start_apply_stream(spark, src, root, os.path.join(scratch, "c2"), buckets=4).awaitTermination(120)
    store = cdc.StateStore(spark, root, 4)
    want = cdc.apply_changes(cdc.empty_state(spark), feed(spark, [(1, 1, "I", 1.0), (2, 1, "U", 2.0), (3, 2, "I", 3.0)]))
    assert state_rows(store.read()) == state_rows(want)


def test_second_initialize_keeps_the_first_until_it_commits(spark, scratch, monkeypatch):
    from depotlens.operators import fsio
    store = cdc.StateStore(spark, scratch, buckets=4)
    rows = lambda v: cdc.apply_changes(cdc.empty_state(spark), feed(spark, [(i, i, "I", v) for i in range(1, 9)]))
    store.initialize(rows(1.0))
    before = state_rows(store.read())
    real = fsio.write_text_atomic
    monkeypatch.setattr(fsio, "write_text_atomic", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    try:
        store.initialize(rows(2.0))
    except RuntimeError:
        pass
    monkeypatch.setattr(fsio, "write_text_atomic", real)
    assert state_rows(store.read()) == before
    store.initialize(rows(2.0))
    assert state_rows(store.read()) != before and store.read().count() == 8


def test_null_keys_do_not_multiply(spark):
    change = feed(spark, [(5, None, "I", 1.0)])
    state = cdc.empty_state(spark)
    for _ in range(3):
        state = cdc.apply_changes(state, change)
    assert state.count() == 1


def test_one_file_per_bucket_and_old_folders_go(spark, scratch):
    from depotlens.operators import fsio
    store = cdc.StateStore(spark, scratch, buckets=4)
    for epoch in range(5):
        store.apply(feed(spark, [(100 * epoch + i, i, "U", float(epoch)) for i in range(1, 60)]).repartition(6), epoch)
    folders = list(store.manifest()["buckets"].values())
    assert all(len([f for f in spark.read.parquet(p).inputFiles()]) == 1 for p in folders)
    assert len(fsio.list_dirs(spark, scratch + "/_epochs")) == 2  # the committed batch and the one before


def test_crash_before_commit_then_replay(spark, scratch, monkeypatch):
    from depotlens.operators import fsio
    store = cdc.StateStore(spark, scratch, buckets=4)
    base = [(i, i, "I", float(i)) for i in range(1, 21)]
    assert store.apply(feed(spark, base), 0)
    before = state_rows(store.read())
    batch = [(30, 3, "U", 9.0), (31, 4, "D", None), (32, 99, "I", 1.0)]
    real = fsio.write_text_atomic

    def crash(*a, **k):
        raise RuntimeError("executor lost before commit")
    monkeypatch.setattr(fsio, "write_text_atomic", crash)
    try:
        store.apply(feed(spark, batch), 1)
    except RuntimeError:
        pass
    monkeypatch.setattr(fsio, "write_text_atomic", real)
    assert state_rows(store.read()) == before and store.current_version() == 0   # nothing half-applied
    assert store.apply(feed(spark, batch), 1)                                    # replay of the epoch
    want = cdc.apply_changes(cdc.empty_state(spark), feed(spark, base + batch))
    assert state_rows(store.read()) == state_rows(want)
