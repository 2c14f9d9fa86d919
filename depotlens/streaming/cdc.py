"""Change-data apply: initial copy + insert/update/delete feed, batch and streaming.

A change row is ``(lsn, table, key, op, value, ts)``; ``op`` is I/U/D and
``lsn`` orders changes.  Applying a batch is last-writer-wins per (table, key):

* the latest change per key is the first by LSN; every task keeps one row per
  key before the shuffle, so a key that owns a third of the feed is reduced
  there, never sorted in one task;
* the state keeps the LSN that produced each row (``_lsn``), and a delete
  leaves a tombstone (``_deleted``) so the key's LSN is remembered; a change
  whose LSN is not newer than the state's LSN for that key is skipped, so
  replaying a batch or applying an old batch late leaves the state unchanged
  (exactly-once effect over at-least-once delivery).  ``visible`` hides the
  tombstones;
* state and latest changes meet in one full outer join on the key, for which
  either is shuffled once.

``start_apply_stream`` runs the same function in ``foreachBatch`` over a
Structured Streaming file source into a ``StateStore``: the state is hash-
bucketed on the key, each micro-batch rewrites only the buckets it touches
under its epoch folder and then swaps a manifest, so a restarted query
replays the batch from the checkpoint and rewrites the same epoch folder.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import fsio

CHANGE_SCHEMA = T.StructType([
    T.StructField("lsn", T.LongType()), T.StructField("table", T.StringType()),
    T.StructField("key", T.LongType()), T.StructField("op", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("ts", T.TimestampNTZType()),
])
KEY = ["table", "key"]

# Source schemas published for replication, and the tables the
# fixture change feed spreads its rows over (by props.k mod 5).
PUBLISHED_SCHEMAS = ["public", "wms", "inventory", "orders", "shipping", "receiving", "warehouse", "locations",
                     "products", "customers", "suppliers"]
FEED_TABLES = ["orders.orders", "inventory.inventory", "shipping.shipments", "receiving.receipts",
               "staging.import_buffer"]
EVENT_OPS = {"signup": "I", "error": "D"}  # every other event type is an update


def change_feed_from_events(events: DataFrame) -> DataFrame:
    """Fixture change feed: lsn=event_id, key=user_id, op by event type,
    table by the props JSON field k."""
    k = F.get_json_object("props", "$.k").cast("int")
    tables = F.array(*[F.lit(t) for t in FEED_TABLES])
    op = None
    for etype, code in EVENT_OPS.items():
        op = F.when(F.col("event_type") == etype, code) if op is None else op.when(F.col("event_type") == etype, code)
    op = op.otherwise("U")
    return events.select(F.col("event_id").alias("lsn"),
                         F.element_at(tables, (F.pmod(k, F.lit(len(FEED_TABLES))) + 1)).alias("table"),
                         F.col("user_id").alias("key"), op.alias("op"), "value", "ts")


def select_tables(feed: DataFrame, schemas: list[str] | None = None, tables: list[str] | None = None) -> DataFrame:
    """Publication scope: all tables of the listed schemas, or an explicit list."""
    if tables is not None:
        return feed.where(F.col("table").isin(tables))
    schemas = schemas if schemas is not None else PUBLISHED_SCHEMAS
    return feed.where(F.split_part(F.col("table"), F.lit("."), F.lit(1)).isin(schemas))


def filter_ops(feed: DataFrame, publish: tuple[str, ...] = ("insert", "update", "delete")) -> DataFrame:
    """Publication operation filter (publish = 'insert, update, delete' subset)."""
    code = {"insert": "I", "update": "U", "delete": "D"}
    return feed.where(F.col("op").isin([code[p] for p in publish]))


def latest_changes(changes: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Last change per key by LSN (partial aggregation, hot-key safe)."""
    payload = [c for c in changes.columns if c not in key]
    return (changes.groupBy(*key)
            .agg(F.max_by(F.struct(*payload), F.col("lsn")).alias("_c"))
            .select(*key, "_c.*"))


META = ["_lsn", "_deleted"]


def empty_state(spark: SparkSession, feed_schema: T.StructType = CHANGE_SCHEMA) -> DataFrame:
    fields = [f for f in feed_schema.fields if f.name not in ("op", "lsn")]
    schema = T.StructType(fields + [T.StructField("_lsn", T.LongType()), T.StructField("_deleted", T.BooleanType())])
    return spark.createDataFrame([], schema)


def initial_copy(rows: DataFrame, lsn: int = 0) -> DataFrame:
    """Version 0 of a state table from a bulk copy (every row at ``lsn``)."""
    return rows.withColumn("_lsn", F.lit(lsn).cast("long")).withColumn("_deleted", F.lit(False))


def visible(state: DataFrame) -> DataFrame:
    """Rows a reader sees: tombstones hidden, bookkeeping columns dropped."""
    return state.where(~F.col("_deleted")).drop("_deleted")


def _comparable(df: DataFrame, key: list[str], digest: bool = False) -> tuple[dict[str, Column], dict[str, Column]]:
    """Key columns that are never NULL, and the key made of them again: equal
    keys (NULL parts included) have equal columns, so that one plain
    partitioning serves a grouping and a join on them.  ``digest``: texts are
    compared by their 128-bit MD5, which does not give the text back."""
    parts, back = {}, {}
    for k in key:
        n, z = f"_n_{k}", f"_z_{k}"
        kind = df.schema[k].dataType
        if isinstance(kind, T.IntegralType):
            parts |= {n: F.coalesce(F.col(k), F.lit(0).cast(kind)), z: F.col(k).isNull()}
            back[k] = F.when(~F.col(z), F.col(n))
        elif digest:
            parts[n] = F.coalesce(F.unhex(F.md5(F.col(k).cast("string"))), F.lit(b""))
            back[k] = F.coalesce(F.col(f"_s_{k}"), F.col(f"_c_{k}"))
        else:
            parts[n] = F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit(""))
            back[k] = F.when(F.col(n) != "", F.substring(F.col(n), 2, 2**31 - 1)).cast(kind)
    return parts, back


def apply_changes(state: DataFrame, changes: DataFrame, key: list[str] = KEY, digest: bool = False) -> DataFrame:
    """New state = state merged with the latest change per key; a change not
    newer than the key's state LSN is skipped, a delete leaves a tombstone.

    Both sides are shuffled once, on the key: the latest change is ranked first
    (before the shuffle each task keeps one row per key, so a hot key is reduced
    there) and joined where it lies.  Columns that no reader asks for are not
    shuffled; with ``digest`` (for long keys, such as whole rows as text) nor
    are text keys, which then meet by their digests."""
    cols = [c for c in state.columns if c not in key and c not in META]
    # NULL key parts are equal here, or every replay would add the row again
    parts, back = _comparable(state, key, digest)
    s = state.select(*[c.alias(n) for n, c in parts.items()], *[F.col(c).alias(f"_s_{c}") for c in cols + key], F.col("_lsn").alias("_s_lsn"),
                     F.col("_deleted").alias("_s_del"))
    c = changes.select(*[c.alias(n) for n, c in parts.items()], *[F.col(x).alias(f"_c_{x}") for x in cols + key],
                       (F.col("op") == "D").alias("_c_del"), F.col("lsn").alias("_c_lsn"))
    rank = F.row_number().over(Window.partitionBy(*parts).orderBy(F.col("_c_lsn").desc_nulls_last()))
    last = c.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    j = s.join(last, list(parts), "full")
    newer = F.col("_c_lsn").isNotNull() & (F.col("_s_lsn").isNull() | (F.col("_c_lsn") > F.col("_s_lsn")))
    return j.select(*[back[k].alias(k) for k in key], *[F.when(newer, F.col(f"_c_{x}")).otherwise(F.col(f"_s_{x}")).alias(x) for x in cols],
                    F.when(newer, F.col("_c_lsn")).otherwise(F.col("_s_lsn")).alias("_lsn"),
                    F.when(newer, F.col("_c_del")).otherwise(F.col("_s_del")).alias("_deleted"))


def table_dml_counts(feed: DataFrame, schema_like: str | None = None) -> DataFrame:
    """Per table: inserts, updates, deletes and live rows (inserts - deletes);
    ``schema_like`` keeps schemas matching a SQL LIKE pattern (e.g. '%analytics%')."""
    op = F.col("op")
    schema = F.split_part(F.col("table"), F.lit("."), F.lit(1))
    if schema_like is not None:
        feed = feed.where(schema.like(schema_like))
    g = feed.groupBy(schema.alias("schemaname"),
                     F.split_part(F.col("table"), F.lit("."), F.lit(2)).alias("tablename")).agg(
        F.count(F.when(op == "I", 1)).alias("inserts"), F.count(F.when(op == "U", 1)).alias("updates"),
        F.count(F.when(op == "D", 1)).alias("deletes"))
    return g.withColumn("live_tuples", F.col("inserts") - F.col("deletes"))


# --- streaming wrapper ------------------------------------------------------------------

class StateStore:
    """State table in a shared folder, hash-bucketed on the key.

    Layout: ``<root>/_epochs/e=<attempt>/_bucket=<b>/part-*`` plus a manifest
    ``<root>/_manifest.json`` = {"epoch": last batch, "buckets": {b: folder}}.
    A micro-batch rewrites the buckets its changes touch, then swaps the
    manifest in one rename; untouched buckets keep pointing at the folders of
    earlier batches.  Every attempt writes a folder of its own name, so
    neither a replay nor a new stream whose batch numbers start again can
    overwrite what the manifest points at.  Batch numbers decide nothing: a
    change is applied if it is newer than its key's LSN, so replays are
    harmless and no batch is ever skipped.  Folders that neither the committed
    nor the previous manifest names are deleted after a commit.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, key: list[str] = KEY,
                 payload: T.StructType | None = None, manifest_path: str | None = None,
                 section: str = "buckets", bucket_by: list[str] | None = None):
        """``payload``: schema of the stored columns (key included); defaults
        to the generic change feed's (table, key, value, ts).  ``manifest_path``
        / ``section`` let a larger job keep this store's bucket map in its own
        manifest, so several stores commit in one rename.  ``bucket_by``: the
        columns rows are bucketed by, if not the key."""
        self.spark, self.root, self.buckets, self.key = spark, root, buckets, list(key)
        self.bucket_by = list(bucket_by or key)
        self.manifest_path, self.section = manifest_path or os.path.join(root, "_manifest.json"), section
        fields = (payload.fields if payload is not None
                  else [f for f in CHANGE_SCHEMA.fields if f.name not in ("op", "lsn")])
        self.schema = T.StructType(list(fields) + [T.StructField("_lsn", T.LongType()),
                                                   T.StructField("_deleted", T.BooleanType())])

    def bucket_of(self) -> F.Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.bucket_by]), F.lit(self.buckets)).cast("int")

    def _manifest_path(self) -> str:
        return self.manifest_path

    def manifest(self) -> dict:
        text = fsio.read_text(self.spark, self._manifest_path())
        m = json.loads(text) if text else {"epoch": None}
        m.setdefault(self.section, {})
        return m

    def current_version(self) -> int | None:
        return self.manifest()["epoch"]

    def _read_paths(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, buckets: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        m = (manifest or self.manifest())[self.section]
        keys = [str(b) for b in buckets] if buckets is not None else list(m)
        return self._read_paths([m[k] for k in keys if k in m])

    def _stage(self, m: dict, new: DataFrame | None, touched: list[int], epoch: int) -> None:
        """Write the touched buckets of ``new`` under a folder of this attempt
        and point this store's manifest section at them (manifest not written)."""
        if new is not None and touched:
            stage = os.path.join(self.root, "_epochs", f"e={epoch}-{uuid.uuid4().hex[:12]}")
            new.withColumn("_bucket", self.bucket_of()).repartition("_bucket").write \
               .partitionBy("_bucket").parquet(stage)  # one file per bucket
            written = {d.split("=", 1)[1] for d in fsio.list_dirs(self.spark, stage) if d.startswith("_bucket=")}
            for b in touched:  # a touched bucket left without rows is dropped from the manifest
                if str(b) in written:
                    m[self.section][str(b)] = os.path.join(stage, f"_bucket={b}")
                else:
                    m[self.section].pop(str(b), None)

    def _commit(self, m: dict, new: DataFrame | None, touched: list[int], epoch: int) -> None:
        before = self.manifest()
        self._stage(m, new, touched, epoch)
        m["epoch"] = epoch
        fsio.write_text_atomic(self.spark, self._manifest_path(), json.dumps(m, sort_keys=True))
        self.prune([before, m])

    def prune(self, manifests: list[dict]) -> None:
        """Delete attempt folders that none of ``manifests`` names."""
        live = {os.path.basename(os.path.dirname(p)) for m in manifests for p in m.get(self.section, {}).values()}
        root = os.path.join(self.root, "_epochs")
        for name in fsio.list_dirs(self.spark, root):
            if name not in live:
                fsio.delete(self.spark, os.path.join(root, name))

    def stage_changes(self, m: dict, changes: DataFrame, epoch: int, touched: list[int] | None = None) -> DataFrame:
        """Apply ``changes`` to the touched buckets and stage them into ``m``;
        returns the new rows of those buckets (tombstones included).  If a
        change can move a row to another bucket, ``touched`` names both."""
        touched = self.touched_buckets(changes) if touched is None else touched
        new = apply_changes(self.read(touched, m), changes, self.key) if touched else None
        self._stage(m, new, touched, epoch)
        return new if new is not None else self.spark.createDataFrame([], self.schema)

    def initialize(self, rows: DataFrame, lsn: int = 0) -> None:
        """Initial copy (version -1): every bucket written from ``rows``."""
        m = self.manifest()
        self._commit(m, initial_copy(rows.select(*self.schema.names[:-2]), lsn), list(range(self.buckets)), -1)

    def touched_buckets(self, changes: DataFrame) -> list[int]:
        """Bucket ids a batch touches (at most ``buckets`` small ints reach the driver)."""
        return sorted(r[0] for r in changes.select(self.bucket_of()).distinct().collect())

    def apply(self, changes: DataFrame, epoch: int) -> bool:
        """Apply one batch; ``epoch`` only names it."""
        m = self.manifest()
        touched = self.touched_buckets(changes)
        new = apply_changes(self.read(touched, m), changes, self.key) if touched else None
        self._commit(m, new, touched, epoch)
        return True


def start_apply_stream(spark: SparkSession, source_dir: str, state_root: str, checkpoint: str,
                       available_now: bool = True, processing_time: str | None = None,
                       schemas: list[str] | None = None, buckets: int = 64):
    """Structured Streaming job: change files -> publication filter ->
    foreachBatch(apply into the bucketed state table)."""
    fsio.mkdirs(spark, state_root)
    store = StateStore(spark, state_root, buckets)
    stream = select_tables(spark.readStream.schema(CHANGE_SCHEMA).parquet(source_dir), schemas)

    def apply_batch(batch: DataFrame, epoch_id: int) -> None:
        batch.persist()  # read for its buckets and for its rows
        try:
            store.apply(batch, epoch_id)
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "10 seconds")
    return w.start()


def progress_frame(spark: SparkSession, query) -> DataFrame:
    """Subscription-status style listing of a streaming query's recent progress."""
    rows = [(p.get("batchId"), p.get("timestamp"), p.get("numInputRows"),
             json.dumps(p.get("sources", [{}])[0].get("endOffset")) if p.get("sources") else None)
            for p in (query.recentProgress or [])]
    schema = "batch_id long, progress_ts string, input_rows long, end_offset string"
    return spark.createDataFrame(rows, schema)


# --- incremental V3 ------------------------------------------------------------------------

def incremental_order_performance(t_after, v3_before: DataFrame, changed_orders: DataFrame,
                                  changed_items: DataFrame | None = None) -> DataFrame:
    """Refresh V3 after a change batch: only the order days touched by
    ``changed_orders`` (rows with ``order_date``; old and new images) or by
    ``changed_items`` (rows with ``order_id``) are recomputed from the
    post-apply tables; the other days are kept.

    COUNT(DISTINCT) is not supported in streaming aggregations, hence this
    recompute-touched-buckets form inside ``foreachBatch``.
    """
    from ..functions.exprs import bucket
    from ..plans.orders import order_performance

    touched = changed_orders.select(bucket(F.col("order_date"), "day").alias("order_date"))
    if changed_items is not None:
        theirs = t_after["orders"].join(changed_items.select("order_id"), "order_id", "left_semi")
        touched = touched.unionByName(theirs.select(bucket(F.col("order_date"), "day").alias("order_date")))
    touched = touched.distinct()
    orders = t_after["orders"].withColumn("_d", bucket(F.col("order_date"), "day"))
    orders = orders.join(touched.withColumnRenamed("order_date", "_d"), "_d", "left_semi").drop("_d")
    items = t_after["order_items"].join(orders.select("order_id"), "order_id", "left_semi")
    recomputed = order_performance({"orders": orders, "order_items": items, "warehouses": t_after["warehouses"]})
    kept = v3_before.join(touched, "order_date", "left_anti")
    return kept.unionByName(recomputed)
