"""V3 kept current by signed deltas from order and order-line changes.

A change row is a row of its table plus ``lsn`` and ``op`` (I/U/D).  V3 is a sum
over orders, so it is kept as additive figures per day and warehouse, and a
batch adds the figures that the orders it touches have after the batch and
subtracts those they had before.  Per micro-batch (``foreachBatch``):

1. the touched orders are the changed ones and those that own a changed line,
   before or after (``line_owners`` knows a line's order by its id);
2. changes that are not newer than their key's LSN are dropped (last writer wins,
   tombstones for deletes, as in ``cdc.apply_changes``); the others are written as
   a new layer of the buckets they fall in (``LayeredStore``).  A line that
   changes its order leaves a tombstone with the order it had;
3. orders and lines are both bucketed by ``order_id``, so the touched orders are
   read from their buckets alone: with the new layer they have their new images,
   without it the old ones, and one shuffle on ``order_id`` gives both;
4. the difference is added to the figures of the months it touches (a row per
   day and warehouse), and the states and month folders are committed together
   by one manifest.

What a batch reads grows with the batch and not with the tables, and it writes
its own rows only.  A replayed batch changes nothing: no change in it is newer
than its key's LSN, so it has no layer and nothing is read after step 2.

A sum over no value is NULL, not 0, so every such figure is kept with the number
of orders that have it.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R
from ..functions.exprs import BIG, bucket, micros_between
from ..operators import fsio
from ..operators.rollups import child_rollup, item_aggs, order_rollup
from ..plans.orders import order_figures
from ..sources.tables import SCHEMAS
from .cdc import StateStore, _comparable, initial_copy, visible

_CHANGE = [T.StructField("lsn", T.LongType()), T.StructField("op", T.StringType())]
ORDER_CHANGE_SCHEMA = T.StructType(list(SCHEMAS["orders"].fields) + _CHANGE)
LINE_CHANGE_SCHEMA = T.StructType(list(SCHEMAS["order_items"].fields) + _CHANGE)
OWNER_SCHEMA = T.StructType([f for f in SCHEMAS["order_items"].fields if f.name in ("order_item_id", "order_id")])

GROUP = ["order_date", "warehouse_id"]
#: Figures that are NULL without a value; the others are counts.
SUMS = {"total_quantity_ordered": "sum_ordered", "total_quantity_shipped": "sum_shipped",
        "total_quantity_backordered": "sum_backordered", "price_cents": "price_cents", "price_n": "price_n",
        "value_cents": "value_cents", "n_ordered": "n_ordered"}


def month_key(ts: Column) -> Column:
    """Folder key of an order's month (``none`` for a NULL order date)."""
    return F.coalesce(F.date_format(ts, "yyyyMM"), F.lit("none"))


def figures(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Additive figures of every order: its day, warehouse, counts, and each sum with whether it has a value."""
    return additive(order_rollup(orders, lines, distinct_items=True))


def additive(per: DataFrame, *keep: str) -> DataFrame:
    """``figures`` of orders that have the aggregates of their lines."""
    status, one = F.col("status"), lambda c: F.coalesce(c, F.lit(False)).cast("long")
    counts = {"rows": F.lit(1).cast("long"), "total_orders": one(F.col("order_id").isNotNull()),
              "total_order_items": F.coalesce("n_items", F.lit(0)),
              "completed_orders": one(status == R.ORDER_COMPLETED), "pending_orders": one(status == R.ORDER_PENDING),
              "cancelled_orders": one(status == R.ORDER_CANCELLED)}
    sums = {n: F.col(c) for n, c in SUMS.items()} | {
        "h_sum": F.col("ship_us").cast(BIG) * F.col("w"), "h_n": F.when(F.col("ship_us").isNotNull(), F.col("w"))}
    out = [c.cast(BIG).alias(n) for n, c in counts.items()]
    for n, c in sums.items():
        out += [F.coalesce(c, F.lit(0)).cast(BIG).alias(n), c.isNotNull().cast("int").cast(BIG).alias(f"{n}_has")]
    return per.select(bucket(F.col("order_date"), "day").alias("order_date"), "warehouse_id", *keep, *out)


def added(*parts: DataFrame) -> DataFrame:
    """Figures summed per day and warehouse; groups without an order are gone."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    names = [c for c in rows.columns if c not in GROUP]
    return rows.groupBy(*GROUP).agg(*[F.sum(c).cast(BIG).alias(c) for c in names])


def signed(rows: DataFrame, side: str) -> DataFrame:
    """Figures times their ``side`` (1 or -1)."""
    names = [c for c in rows.columns if c not in (*GROUP, side)]
    return rows.select(*GROUP, *[F.when(F.col(side) > 0, F.col(c)).otherwise(-F.col(c)).cast(BIG).alias(c) for c in names])


def report(kept: DataFrame, warehouses: DataFrame) -> DataFrame:
    """V3 from its kept figures."""
    names = [c for c in kept.columns if c not in GROUP and not c.endswith("_has")]
    as_sum = lambda c: F.when(F.col(f"{c}_has") > 0, F.col(c)).alias(c)
    sums = [as_sum(c) for c in names if f"{c}_has" in kept.columns]
    counts = [F.col(c).cast("long").alias(c) for c in names if f"{c}_has" not in kept.columns]
    g = kept.where("rows > 0").select(*GROUP, *counts, *sums)
    return order_figures(g.withColumns({c: F.col(c).cast("long") for c in (*SUMS, "h_n")}), warehouses)


SMALL = 32 << 20  # bytes of a bucket below which its files are made one
MAX_LAYERS = 8
NEW = 1 << 30  # number of the layer that a batch adds


class LayeredStore(StateStore):
    """A state whose buckets are layers of rows: a batch adds one with the new
    rows of its keys, and of a key (with the columns rows are bucketed by) the
    rows of the newest layer hold.  The manifest lists a bucket's folders,
    oldest first; a bucket of over ``MAX_LAYERS`` is written anew as one."""

    def layers(self, m: dict, buckets: list[int] | None = None) -> DataFrame:
        """Rows of all layers with the number of their layer."""
        mine = m[self.section]
        paths = [mine[k] for k in (map(str, buckets) if buckets is not None else mine) if k in mine]
        out = None
        for i in range(max(map(len, paths), default=1)):
            part = self._read_paths([p[i] for p in paths if len(p) > i]).withColumn("_layer", F.lit(i))
            out = part if out is None else out.unionByName(part)
        return out

    def deep(self, m: dict) -> bool:
        return any(len(p) > 1 for p in m[self.section].values())

    def newest(self, rows: DataFrame, by: list[str]) -> DataFrame:
        top = F.max("_layer").over(Window.partitionBy(*by))
        return rows.withColumn("_top", top).where("_layer = _top").drop("_top")

    def read(self, buckets: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        m = manifest or self.manifest()
        rows = self.layers(m, buckets)
        return (self.newest(rows, list(dict.fromkeys(self.bucket_by + self.key))) if self.deep(m) else rows).drop("_layer")

    def newer(self, m: dict, changes: DataFrame, *old: str) -> DataFrame:
        """Latest change of each key if it is newer than the key's state: a row
        for every row of the state (one, if none), with its columns ``old`` as
        ``_s_<name>`` and ``_s_deleted``."""
        parts, _ = _comparable(changes, self.key)
        state = self.layers(m, self.touched_buckets(changes)).select(
            *[c.alias(n) for n, c in parts.items()], *[F.col(c).alias(f"_s_{c}") for c in old], F.col("_lsn").alias("_s_lsn"),
            F.col("_deleted").alias("_s_deleted"), "_layer")
        if self.deep(m):
            state = self.newest(state, list(parts))
        rank = F.row_number().over(Window.partitionBy(*parts).orderBy(F.col("lsn").desc_nulls_last()))
        last = changes.withColumns(parts).withColumn("_rank", rank).where("_rank = 1").drop("_rank")
        return (last.join(state.drop("_layer"), list(parts), "left").where("lsn is not null and (_s_lsn is null or lsn > _s_lsn)")
                .withColumns({"_lsn": F.col("lsn"), "_deleted": F.col("op") == "D"}).drop(*parts, "lsn", "op", "_s_lsn"))

    def _put(self, rows: DataFrame, epoch: int) -> dict[str, str]:
        """Folder of each bucket of ``rows``, written where they are; only
        buckets of many small files are shuffled into one file each."""
        def write(df: DataFrame) -> dict[str, str]:
            stage = os.path.join(self.root, "_epochs", f"e={epoch}-{uuid.uuid4().hex[:12]}")
            df.write.option("compression", "zstd").partitionBy("_bucket").parquet(stage)
            return {d.split("=", 1)[1]: os.path.join(stage, d) for d in fsio.list_dirs(self.spark, stage) if d.startswith("_bucket=")}

        out = write(rows.withColumn("_bucket", self.bucket_of()))
        small = []
        for b, path in out.items():
            n, size = fsio.files(self.spark, path)
            if n > 1 and size < SMALL:
                small.append(b)
        if small:
            again = self.spark.read.schema(rows.schema).parquet(*[out[b] for b in small])
            merged = write(again.withColumn("_bucket", self.bucket_of()).repartition("_bucket"))
            for b in small:
                fsio.delete(self.spark, out[b])
            out |= merged
        return out

    def add(self, m: dict, rows: DataFrame, epoch: int) -> tuple[DataFrame, list[int]]:
        """Write ``rows`` as the newest layer of their buckets; returns them as written, and the buckets."""
        made = self._put(rows, epoch)
        mine = m[self.section]
        for b, path in made.items():
            mine[b] = [*mine.get(b, []), path]
        full = [int(b) for b in made if len(mine[b]) > MAX_LAYERS]
        if full:
            mine |= {b: [path] for b, path in self._put(self.read(full, m), epoch).items()}
        back = self.spark.read.schema(rows.schema)
        return back.parquet(*made.values()) if made else self.spark.createDataFrame([], rows.schema), [int(b) for b in made]

    def prune(self, manifests: list[dict]) -> None:
        flat = [{self.section: {f"{b}/{i}": p for b, paths in m.get(self.section, {}).items() for i, p in enumerate(paths)}} for m in manifests]
        super().prune(flat)


class IncrementalV3:
    """Orders, lines, line owners and V3's figures by month under one root and one manifest."""

    def __init__(self, spark: SparkSession, root: str, warehouses: DataFrame, buckets: int = 64):
        self.spark, self.root, self.warehouses = spark, root, warehouses
        self.manifest_path = os.path.join(root, "_manifest.json")

        def store(name: str, key: str, payload: T.StructType, by: str) -> LayeredStore:
            return LayeredStore(spark, os.path.join(root, name), buckets, key=[key], payload=payload,
                              manifest_path=self.manifest_path, section=name, bucket_by=[by])

        self.orders = store("orders", "order_id", SCHEMAS["orders"], "order_id")
        self.lines = store("order_items", "order_item_id", SCHEMAS["order_items"], "order_id")
        self.owners = store("line_owners", "order_item_id", OWNER_SCHEMA, "order_item_id")
        self.stores = (self.orders, self.lines, self.owners)

    def manifest(self) -> dict:
        text = fsio.read_text(self.spark, self.manifest_path)
        m = json.loads(text) if text else {"epoch": None}
        for section in (*[s.section for s in self.stores], "v3"):
            m.setdefault(section, {})
        return m

    def _write(self, before: dict, m: dict, epoch: int) -> None:
        m["epoch"] = epoch
        fsio.write_text_atomic(self.spark, self.manifest_path, json.dumps(m, sort_keys=True))
        for store in self.stores:
            store.prune([before, m])
        live = {os.path.basename(os.path.dirname(p)) for x in (before, m) for p in x["v3"].values()}
        root = os.path.join(self.root, "v3", "_epochs")
        for name in fsio.list_dirs(self.spark, root):
            if name not in live:
                fsio.delete(self.spark, os.path.join(root, name))

    def _stage_v3(self, m: dict, rows: DataFrame, months: list[str] | None, epoch: int) -> None:
        stage = os.path.join(self.root, "v3", "_epochs", f"e={epoch}-{uuid.uuid4().hex[:12]}")
        rows.where("rows > 0").withColumn("_month", month_key(F.col("order_date"))).repartition("_month").write \
            .partitionBy("_month").parquet(stage)  # one file per month
        written = {d.split("=", 1)[1] for d in fsio.list_dirs(self.spark, stage) if d.startswith("_month=")}
        for d in (months if months is not None else sorted(written)):
            if d in written:
                m["v3"][d] = os.path.join(stage, f"_month={d}")
            else:  # the month lost its last order
                m["v3"].pop(d, None)

    def initialize(self, orders: DataFrame, order_items: DataFrame, lsn: int = 0) -> None:
        """Initial copy of both tables and the figures computed from it (epoch
        -1); what an earlier copy committed stays readable until the new one is."""
        before, m = self.manifest(), self.manifest()
        orders, lines = orders.select(*SCHEMAS["orders"].names), order_items.select(*SCHEMAS["order_items"].names)
        for store, rows in ((self.orders, orders), (self.lines, lines), (self.owners, lines.select(*OWNER_SCHEMA.names))):
            m[store.section] = {}
            store.add(m, initial_copy(rows, lsn), -1)
        m["v3"] = {}
        # by order at once: its distinct lines are counted and joined to it where they lie
        self._stage_v3(m, added(figures(orders, lines.repartition("order_id"))), None, -1)
        self._write(before, m, -1)

    def _kept(self, m: dict, months: list[str] | None = None) -> DataFrame:
        paths = [p for d, p in m["v3"].items() if months is None or d in months]
        schema = added(figures(*(self.spark.createDataFrame([], SCHEMAS[n]) for n in ("orders", "order_items")))).schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read_v3(self) -> DataFrame:
        return report(self._kept(self.manifest()), self.warehouses)

    def read_orders(self) -> DataFrame:
        return visible(self.orders.read()).drop("_lsn")

    def read_lines(self) -> DataFrame:
        return visible(self.lines.read()).drop("_lsn")

    def _sides(self, store: LayeredStore, m: dict, layer: DataFrame, ids: DataFrame, touched: list[int]) -> DataFrame:
        """Visible rows of the orders ``ids`` before (``_side`` -1) and after (1)
        ``layer`` is added to ``m``, all rows of an order in one partition."""
        rows = store.layers(m, touched).unionByName(layer.select(*store.schema.names).withColumn("_layer", F.lit(NEW)))
        rows = rows.repartition("order_id").join(ids, "order_id", "left_semi")
        w = Window.partitionBy(*dict.fromkeys(["order_id", *store.key]))
        at = F.col("_layer")
        rows = rows.withColumns({"_was": F.max(F.when(at < NEW, at)).over(w), "_is": F.max(at).over(w)}).where(~F.col("_deleted"))
        side = F.array_compact(F.array(F.when(at == F.col("_was"), -1), F.when(at == F.col("_is"), 1)))
        return rows.withColumn("_side", F.explode(side)).drop("_was", "_is", "_layer")

    def _delta(self, before: dict, order_layer: DataFrame, line_layer: DataFrame, ids: DataFrame, touched: list[int]) -> DataFrame:
        """What the layers change in the figures."""
        orders = self._sides(self.orders, before, order_layer, ids, touched)
        lines = self._sides(self.lines, before, line_layer, ids, touched)
        names = ["n_child", *item_aggs(True)]
        per = lines.groupBy("order_id", "_side").agg(F.count(F.lit(1)).alias("n_child"), *[c.alias(n) for n, c in item_aggs(True).items()])
        both = per.groupBy("order_id").agg(*[F.first(F.when(F.col("_side") == side, F.struct(*names)), ignorenulls=True).alias(name)
                                             for side, name in ((-1, "_was"), (1, "_is"))])
        j = orders.join(both, "order_id", "left").withColumn("_items", F.when(F.col("_side") == 1, F.col("_is")).otherwise(F.col("_was")))
        j = j.select(*orders.columns, "_items.*").withColumn("w", F.coalesce("n_child", F.lit(1)).cast("long"))
        return added(signed(additive(j.withColumn("ship_us", micros_between(F.col("order_date"), F.col("ship_date"))), "_side"), "_side"))

    def _line_layer(self, m: dict, line_changes: DataFrame) -> DataFrame:
        """New rows of the changed lines, and tombstones (``_away``) with the orders they had before."""
        new = self.owners.newer(m, line_changes, "order_id")
        here = F.struct("order_id", "_deleted", F.lit(False).alias("_away"))
        left = F.struct(F.col("_s_order_id").alias("order_id"), F.lit(True).alias("_deleted"), F.lit(True).alias("_away"))
        moved = ~F.coalesce("_s_deleted", F.lit(True)) & ~F.col("order_id").eqNullSafe(F.col("_s_order_id"))
        at = F.explode(F.array_compact(F.array(here, F.when(moved, left)))).alias("_at")
        rest = [c for c in self.lines.schema.names if c not in ("order_id", "_deleted")]
        return new.select(*rest, at).select(*rest, "_at.*").select(*self.lines.schema.names, "_away")

    def apply(self, order_changes: DataFrame, line_changes: DataFrame | None = None, epoch: int = 0) -> bool:
        before, m = self.manifest(), self.manifest()
        names = self.orders.schema.names
        order_layer, touched = self.orders.add(m, self.orders.newer(before, order_changes).select(*names), epoch)
        line_layer = self.spark.createDataFrame([], self.lines.schema)
        if line_changes is not None:
            line_layer, more = self.lines.add(m, self._line_layer(before, line_changes), epoch)
            touched = sorted({*touched, *more})
            if more:
                self.owners.add(m, line_layer.where("not _away").select(*self.owners.schema.names), epoch)
        if touched:
            ids = order_layer.select("order_id").unionByName(line_layer.select("order_id")).distinct().persist()  # as many as the batch has
            delta = self._delta(before, order_layer, line_layer, ids, touched).persist()
            try:
                months = sorted(r.d for r in delta.select(month_key(F.col("order_date")).alias("d")).distinct().collect())  # calendar-bounded
                if months:
                    self._stage_v3(m, added(self._kept(before, months), delta), months, epoch)
            finally:
                delta.unpersist()
                ids.unpersist()
        self._write(before, m, epoch)
        return True


def start_incremental_v3_stream(spark: SparkSession, orders_dir: str, lines_dir: str, job: IncrementalV3, checkpoint: str,
                                available_now: bool = True, processing_time: str | None = None):
    """Structured Streaming job: change files of both tables -> ``job.apply`` per batch."""
    as_struct = {n: T.StructType(list(SCHEMAS[n].fields)) for n in ("orders", "order_items")}

    def side(path: str, schema: T.StructType, mine: str) -> DataFrame:
        rows = spark.readStream.schema(schema).parquet(path)
        cols = [F.struct(*SCHEMAS[n].names).alias(n) if n == mine else F.lit(None).cast(kind).alias(n) for n, kind in as_struct.items()]
        return rows.select(*cols, "lsn", "op")

    both = side(orders_dir, ORDER_CHANGE_SCHEMA, "orders").unionByName(side(lines_dir, LINE_CHANGE_SCHEMA, "order_items"))

    def apply_batch(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            part = {n: batch.where(F.col(n).isNotNull()).select(f"{n}.*", "lsn", "op") for n in as_struct}
            job.apply(part["orders"], part["order_items"], epoch)
        finally:
            batch.unpersist()

    w = both.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "10 seconds")
    return w.start()
