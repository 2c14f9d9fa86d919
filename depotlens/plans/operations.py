"""Registered keys for snapshots/refresh, change-data apply and health reports."""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bitmaps, fsio
from ..operators import snapshots as S
from ..session import checkpoint_root, split_to_sort
from ..sources import bucketed, feed_fixture, monthly
from ..sources.fixtures import AS_OF, fixture_tables
from ..sources.tables import SCHEMAS
from ..streaming import cdc, incremental, replica
from . import customers, health, inventory, ordering, supply_chain
from .orders import hourly_operations, order_performance, warehouse_monthly_ranking, weekly_order_summary
from .warehouse import daily_shipping_receiving, shipping_receiving_performance

PREVIOUS_AS_OF = dt.date(2001, 6, 1)
# Fixture micro-batch boundaries of the change feed (event time).
BATCH_EDGES = [dt.datetime(2024, 1, 11), dt.datetime(2024, 1, 21)]


def r_unique_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key statistics of all six snapshots at AS_OF (duplicates must be 0)."""
    t = fixture_tables(spark, sf_dir)
    out = None
    for name, build in S.builders().items():
        st = S.key_stats(build(t, AS_OF), S.UNIQUE_KEYS[name], name)
        out = st if out is None else out.unionByName(st)
    return out


def r_base_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key statistics of the base tables whose declared keys the reports rely on."""
    from ..sources.tables import PRIMARY_KEYS
    t = fixture_tables(spark, sf_dir)
    return S.base_key_stats(t, PRIMARY_KEYS)


def r_line_owner_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines that belong to more than one order (there must be none)."""
    return S.lines_of_many_orders(fixture_tables(spark, sf_dir)["order_items"])


def _m4_plain(t, as_of):
    return S.builders()["m4_customer_lifetime_value"](t, as_of).drop("summary_month")


def r_refresh_diff_m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row changes of the customer lifetime snapshot between two monthly refreshes."""
    t = fixture_tables(spark, sf_dir)
    return S.diff(_m4_plain(t, PREVIOUS_AS_OF), _m4_plain(t, AS_OF), ["customer_id"])


def _refreshed(group: str, member: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = fixture_tables(spark, sf_dir)
        root = checkpoint_root(spark, "refreshed", uuid.uuid4().hex)
        for as_of in (PREVIOUS_AS_OF, AS_OF):
            S.refresh(spark, t, group, as_of, root)
        return S.read_snapshot(spark, member, root)
    run.__doc__ = f"Materialise the {group} group, refresh it, and read {member} back from the committed version."
    return run


def export_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export V1 (gzip Parquet, dt= partition, 30-day retention) and read it back."""
    from .warehouse import warehouse_performance
    t = fixture_tables(spark, sf_dir)
    root = checkpoint_root(spark, "exports", uuid.uuid4().hex)
    for _ in range(2):  # the second run replaces what readers see of the first
        S.export_snapshot(spark, warehouse_performance(t), root, "v1_warehouse_performance", AS_OF)
    return S.read_export(spark, root, "v1_warehouse_performance", AS_OF)


def r_refresh_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refresh by group name: the rows of every member, and the error of a name that is no group."""
    t = fixture_tables(spark, sf_dir)
    root, out = checkpoint_root(spark, "refreshed", uuid.uuid4().hex), []
    for group in ("daily", "weekly", "monthly", "hourly"):
        try:
            done = S.refresh(spark, t, group, AS_OF, root)
            out += [(group, name, info["rows"], None) for name, info in done.items()]
        except ValueError as error:
            out.append((group, None, None, str(error).split(";")[0]))
    return spark.createDataFrame(out, "group_name string, snapshot string, rows long, error string")


def r_refresh_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refresh groups due in every hour in which an order came."""
    hours = fixture_tables(spark, sf_dir)["orders"].select(F.date_trunc("HOUR", "order_date").cast("timestamp_ntz").alias("hour")).distinct()
    return hours.select("hour", F.explode(S.due(F.col("hour"))).alias("group_name"))


def sc_view_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over report views that are computed on read, through CTEs that use one view twice."""
    from .registry import ReportViews
    views = ReportViews(spark, lambda: fixture_tables(spark, sf_dir), AS_OF)
    return views.sql(VIEW_SQL)


#: Plain SQL over the report views; the oracle runs the same text over its own versions of them.
VIEW_SQL = """WITH per_warehouse AS (
    SELECT warehouse_id, sum(total_orders) AS orders, sum(total_order_value) AS value FROM v3_order_performance GROUP BY warehouse_id),
  whole AS (SELECT sum(orders) AS orders FROM per_warehouse)
SELECT w.warehouse_id, v.warehouse_name, CAST(w.orders AS BIGINT) AS orders, CAST(w.value AS DECIMAL(38, 2)) AS order_value,
       w.orders * 100 >= (SELECT orders FROM whole) * 5 AS busy
FROM per_warehouse w JOIN v1_warehouse_performance v ON w.warehouse_id = v.warehouse_id"""


class _Bucketed(dict):
    """The tables of a report from the co-bucketed layout."""

    def __init__(self, spark: SparkSession, sf_dir: str, names: list[str]):
        name = uuid.uuid4().hex
        root, t = checkpoint_root(spark, "bucketed", name), fixture_tables(spark, sf_dir)
        buckets = bucketed.buckets_for(sum(fsio.size(spark, os.path.join(sf_dir, f"{n}.parquet")) for n in ("orders", "lineitem")))
        super().__init__(bucketed.write_bucketed(t, root, f"b_{name}_", buckets, names))


def _on_buckets(report, names: list[str], *args):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(_Bucketed(spark, sf_dir, names), *args)
    run.__doc__ = f"{report.__name__} over tables bucketed by parent id."
    return run


def _on_months(report, names: list[str], *args):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = checkpoint_root(spark, "monthly", uuid.uuid4().hex)
        monthly.write_monthly(fixture_tables(spark, sf_dir), root, names=names)
        return report(monthly.load_monthly(spark, root, names), *args)
    run.__doc__ = f"{report.__name__} over tables partitioned by month, lines pruned at run time."
    return run


def agg_bitmap_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct customers per warehouse and day, week and month: weeks and
    months are merged from the stored bitmaps of their days."""
    orders = fixture_tables(spark, sf_dir)["orders"]
    day = F.date_trunc("DAY", "order_date").cast("timestamp_ntz")
    path = checkpoint_root(spark, "bitmaps", uuid.uuid4().hex)
    bitmaps.bitmaps(orders, [day.alias("period"), "warehouse_id"], "customer_id").write.parquet(path)
    days, out = spark.read.parquet(path), None
    for unit in ("day", "week", "month"):
        start = F.date_trunc(unit, "period").cast("timestamp_ntz").alias("period")
        maps = days if unit == "day" else bitmaps.merge(days, [start, "warehouse_id"])
        part = bitmaps.cardinality(maps, "unique_customers").select(F.lit(unit).alias("unit"), "period", "warehouse_id", "unique_customers")
        out = part if out is None else out.unionByName(part)
    return out


def _positions(name: str):
    """The report with every row's place in its ORDER BY."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .registry import REPORTS
        return ordering.positions(name, REPORTS[name](spark, sf_dir))
    run.__doc__ = f"{name} with the place of every row in its ORDER BY (a global range-partitioned sort)."
    return run


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.change_feed_from_events(fixture_tables(spark, sf_dir).raw["events"])


def cdc_table_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.select_tables(_feed(spark, sf_dir)).select("lsn", "table", "key", "op")


def c_filter_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication that publishes inserts and updates only."""
    return cdc.filter_ops(_feed(spark, sf_dir), ("insert", "update")).select("lsn", "table", "key", "op")


def _state_out(state: DataFrame) -> DataFrame:
    return cdc.visible(state).select("table", "key", "value", "ts", F.col("_lsn").alias("lsn"))


def c_apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicated tables after applying the whole feed to an empty copy."""
    feed = cdc.select_tables(_feed(spark, sf_dir))
    return _state_out(cdc.apply_changes(cdc.empty_state(spark), feed))


def c_idempotent_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same end state when batches are applied, replayed and re-sent late:
    b1, b2, b2 again, b3, b1 again."""
    feed = cdc.select_tables(_feed(spark, sf_dir))
    ts = F.col("ts")
    b1 = feed.where(ts < F.lit(BATCH_EDGES[0]).cast("timestamp_ntz"))
    b2 = feed.where((ts >= F.lit(BATCH_EDGES[0]).cast("timestamp_ntz")) & (ts < F.lit(BATCH_EDGES[1]).cast("timestamp_ntz")))
    b3 = feed.where(ts >= F.lit(BATCH_EDGES[1]).cast("timestamp_ntz"))
    state = cdc.empty_state(spark)
    for b in (b1, b2, b2, b3, b1):
        state = cdc.apply_changes(state, b)
    return _state_out(state)


def c_incremental_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 kept current: snapshot of the initial copy (orders before as_of - 30
    days, without the lines of every tenth order), then a batch of the newer
    orders and of the missing lines recomputes only the days of either."""
    from ..functions.exprs import minus, ts_lit
    t = fixture_tables(spark, sf_dir)
    cut = ts_lit(minus(AS_OF, days=30))
    late = F.col("order_id") % 10 == 3
    before = {"orders": t["orders"].where(F.col("order_date") < cut), "order_items": t["order_items"].where(~late),
              "warehouses": t["warehouses"]}
    changed = t["orders"].where(F.col("order_date") >= cut)
    return cdc.incremental_order_performance(t, order_performance(before), changed, t["order_items"].where(late))


def c_delta_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 kept by signed deltas: a copy with old images, strangers and gaps, then
    one batch of inserts, updates and deletes of orders and lines (lines of
    every tenth order change their order), applied twice."""
    t = fixture_tables(spark, sf_dir)
    orders, lines, oid = t["orders"], t["order_items"], F.col("order_id")
    job = incremental.IncrementalV3(spark, checkpoint_root(spark, "delta_v3", uuid.uuid4().hex), t["warehouses"], buckets=4)
    old = orders.where(oid % 7 == 1).withColumn("status", F.lit("pending")).withColumn("warehouse_id", F.lit(None).cast("long"))
    strange = orders.where(oid % 7 == 4).withColumn("order_id", -1 - oid)
    elsewhere = lines.where(oid % 10 == 5).withColumn("order_id", oid + 1)
    job.initialize(orders.where(~(oid % 7).isin(1, 2)).unionByName(old).unionByName(strange),
                   lines.where(~(oid % 10).isin(3, 5)).unionByName(elsewhere))
    sent = lambda rows, op, lsn: rows.select("*", F.lit(lsn).cast("long").alias("lsn"), F.lit(op).alias("op"))
    order_changes = (sent(orders.where(oid % 7 == 1), "U", 10).unionByName(sent(orders.where(oid % 7 == 2), "I", 11))
                     .unionByName(sent(strange, "D", 12)))
    line_changes = sent(lines.where(oid % 10 == 3), "I", 13).unionByName(sent(lines.where(oid % 10 == 5), "U", 14))
    for epoch in range(2):
        job.apply(order_changes, line_changes, epoch)
    return job.read_v3()


class _Replicated(dict):
    """Tables as their replicas have them: initial copy and typed change feed,
    merged where they are read.  ``stored``: tables that a report reads more
    than once; copy and feed are merged once for them."""

    def __init__(self, spark: SparkSession, sf_dir: str, stored: tuple[str, ...] = ()):
        super().__init__()
        split_to_sort(spark)
        self.stored = stored
        self.source = fixture_tables(spark, sf_dir)

    def images(self, name: str) -> tuple[DataFrame, DataFrame]:
        """Copy and changes of a table."""
        return (replica.copied(feed_fixture.copy_of(self.source, name), name, feed_fixture.STARTED),
                replica.typed(feed_fixture.feed_of(self.source, name), name))

    def made(self, name: str, **columns: Column) -> DataFrame:
        """Columns made of single rows of a replica: every image gives its own,
        and key, LSN and they are all that is shuffled to merge the images."""
        copy, changes = [rows.select(*replica.KEYS[name], *[c.alias(n) for n, c in columns.items()], *own)
                         for rows, own in zip(self.images(name), (cdc.META, ["lsn", "op"]))]
        return cdc.visible(replica.merged(copy, changes, name, feed_fixture.STARTED)).select(*columns)

    def __missing__(self, name: str) -> DataFrame:
        self[name] = replica.table_of(replica.merged(*self.images(name), name, feed_fixture.STARTED), name)
        if name in self.stored:
            spark = self[name].sparkSession
            path = checkpoint_root(spark, "feed", f"{uuid.uuid4().hex}_merged_{name}")
            self[name].write.option("compression", "zstd").parquet(path)
            self[name] = spark.read.schema(SCHEMAS[name]).parquet(path)
        return self[name]


def _on_replicas(report, *args, stored: tuple[str, ...] = ()):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(_Replicated(spark, sf_dir, stored), *args)
    run.__doc__ = f"{report.__name__} over replicated tables (initial copy and typed change feed)."
    return run


def c_replica_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each replicated table, and those with a NULL in any column."""
    t, out = _Replicated(spark, sf_dir), None
    for name, schema in SCHEMAS.items():
        whole = None
        for c in schema.names:
            whole = F.col(c).isNull() if whole is None else whole | F.col(c).isNull()
        part = t.made(name, _null=whole).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"),
                                             F.count(F.when(F.col("_null"), 1)).alias("rows_with_null"))
        out = part if out is None else out.unionByName(part)
    return out


def o_replication_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.replication_lag(health.lag_samples(fixture_tables(spark, sf_dir).raw["events"]))


def o_slow_queries_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.slow_queries_topk(health.query_log(fixture_tables(spark, sf_dir).raw["events"]))


def o_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.column_profile(fixture_tables(spark, sf_dir))


def o_table_dml_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.table_dml_counts(_feed(spark, sf_dir))


OPERATIONS = {
    "r_unique_key_check": r_unique_key_check,
    "r_base_key_check": r_base_key_check,
    "r_line_owner_check": r_line_owner_check,
    "r_refresh_diff_m4": r_refresh_diff_m4,
    "r_refresh_daily": _refreshed("daily", "m6_daily_shipping_receiving"),
    "r_refresh_weekly": _refreshed("weekly", "m3_weekly_order_summary"),
    "r_refresh_monthly": _refreshed("monthly", "m2_monthly_inventory_summary"),
    "export_snapshot": export_snapshot,
    "r_refresh_dispatch": r_refresh_dispatch,
    "r_refresh_cadence": r_refresh_cadence,
    "sc_view_cte": sc_view_cte,
    "sc_bucketed_v3": _on_buckets(order_performance, ["warehouses", "orders", "order_items"]),
    "sc_bucketed_m3": _on_buckets(weekly_order_summary, ["warehouses", "orders", "order_items"], AS_OF),
    "sc_bucketed_q3": _on_buckets(customers.customer_rfm, ["customers", "orders", "order_items", "products"], AS_OF),
    "sc_bucketed_v5": _on_buckets(shipping_receiving_performance, ["warehouses", "shipments", "shipment_items", "receipts", "receipt_items"]),
    "sc_monthly_m3": _on_months(weekly_order_summary, ["warehouses", "orders", "order_items"], AS_OF),
    "sc_monthly_m6": _on_months(daily_shipping_receiving, ["warehouses", "shipments", "shipment_items", "receipts", "receipt_items"], AS_OF),
    "sc_monthly_q1": _on_months(warehouse_monthly_ranking, ["warehouses", "orders", "order_items"], AS_OF),
    "sc_monthly_q4": _on_months(hourly_operations, ["warehouses", "orders", "order_items"], AS_OF),
    "agg_bitmap_customers": agg_bitmap_customers,
    "so_v4_positions": _positions("v4_customer_insights"),
    "so_q1_positions": _positions("q1_warehouse_monthly_ranking"),
    "so_q3_positions": _positions("q3_customer_rfm"),
    "so_q4_positions": _positions("q4_hourly_operations"),
    "so_q5_positions": _positions("q5_supply_chain"),
    "cdc_table_selection": cdc_table_selection,
    "c_apply_changes": c_apply_changes,
    "c_filter_ops": c_filter_ops,
    "c_idempotent_replay": c_idempotent_replay,
    "c_incremental_v3": c_incremental_v3,
    "c_delta_v3": c_delta_v3,
    "c_replica_counts": c_replica_counts,
    "c_replica_v2": _on_replicas(inventory.inventory_summary),
    "c_replica_v6": _on_replicas(inventory.product_movement_summary),
    "c_replica_q3": _on_replicas(customers.customer_rfm, AS_OF, stored=("orders", "order_items")),
    "c_replica_q5": _on_replicas(supply_chain.supply_chain, AS_OF),
    "o_replication_lag": o_replication_lag,
    "o_slow_queries_topk": o_slow_queries_topk,
    "o_column_profile": o_column_profile,
    "o_table_dml_counts": o_table_dml_counts,
}
