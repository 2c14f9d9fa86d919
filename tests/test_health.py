"""Health reports beyond the oracle parity."""
from depotlens.plans import health


def test_profile_lists_every_repeated_value(spark, small_tables):
    got = health.column_profile(small_tables)
    status = small_tables["orders"].groupBy("status").count().where("count > 1 AND status IS NOT NULL").collect()
    mine = {r.value: r.n for r in got.where("tablename = 'orders' AND attname = 'status'").collect()}
    assert mine == {r.status: r["count"] for r in status}
    days = small_tables["orders"].groupBy("customer_id").count().where("count > 1 AND customer_id IS NOT NULL").count()
    assert got.where("tablename = 'orders' AND attname = 'customer_id'").count() == days > 5
    unique = got.where("tablename = 'orders' AND attname = 'order_id'").collect()
    assert [r.value for r in unique] == [None] and unique[0].n_distinct == unique[0].rows
    assert all(abs(r.frequency - r.n / r.rows) < 1e-12 for r in got.where("value IS NOT NULL").limit(50).collect())


def test_topk_is_bounded(spark):
    log = spark.createDataFrame([(f"q{i % 30}", float(i)) for i in range(300)], "query string, time_ms double")
    rows = health.slow_queries_topk(log, k=20).collect()
    assert len(rows) == 20
    means = [r.mean_time for r in rows]
    assert means == sorted(means, reverse=True)
