"""The twelve base tables as replicas of a source: initial copy, one change feed
for all of them, and a hand-over position that joins the two.

A change row is ``(lsn, table, op, row_id, payload)``: ``op`` is I/U/D, ``lsn``
orders changes, and ``payload`` is the row's image as JSON text (of a deleted
row its key is enough).  ``typed`` turns payloads into the columns of the
table's declared schema; columns the schema does not know are ignored, missing
ones are NULL, and payloads that do not fit are listed by ``rejected``.  Tables
without a declared key (the line tables and movements) are identified by the
source's ``row_id``.

Hand-over.  A copy takes time and the source goes on changing.  The position
read before the copy starts is where the stream takes over: a change up to it
is in the copy and is skipped, every later one is applied.  A row that the copy
caught in a newer state is set back by changes it already had and set forward
again by the ones that follow, so the replica equals the source at every
position from the one read when the copy ended; ``lagging`` tells which tables
have not got there yet.

The stream keeps no state of its own making: ``dropDuplicatesWithinWatermark``
on the arrival time, in the RocksDB state store, drops changes that are sent
twice (arrival time, so that a late change is never dropped as too old), the
streaming checkpoint resumes after a loss, and every batch writes its changes
by table below its own batch number, so a batch that runs twice replaces itself.
Readers merge copy and changes by key, last writer wins on LSN; ``compact``
writes that merge as the next copy, with the LSN of every row and the
tombstones, so changes that come late are judged as before.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import fsio
from ..sources.tables import PRIMARY_KEYS, SCHEMAS
from .cdc import apply_changes, filter_ops, visible

FEED_SCHEMA = T.StructType([
    T.StructField("lsn", T.LongType()), T.StructField("table", T.StringType()), T.StructField("op", T.StringType()),
    T.StructField("row_id", T.StringType()), T.StructField("payload", T.StringType()),
])
ROW_ID = "_row_id"
KEYS: dict[str, list[str]] = {name: [ROW_ID] for name in SCHEMAS} | {name: list(key) for name, key in PRIMARY_KEYS.items()}
TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}  # of a payload: Spark's default cuts to milliseconds
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def columns(name: str) -> list[str]:
    """Columns of the replica of ``name``: its own, and the row id where it has no key."""
    return ([ROW_ID] if KEYS[name] == [ROW_ID] else []) + SCHEMAS[name].names


def payload(name: str) -> Column:
    """A row of ``name`` as JSON text (NULL columns included)."""
    return F.to_json(F.struct(*SCHEMAS[name].names), TIMES | {"ignoreNullFields": "false"})


def changes(rows: DataFrame, name: str, op: str | Column, lsn: Column, row_id: Column | None = None) -> DataFrame:
    """Rows of ``name`` as feed rows."""
    op = F.lit(op) if isinstance(op, str) else op
    row_id = F.lit(None).cast("string") if row_id is None else row_id
    # a generated column, as in _parsed: a condition on it does not write the text once more
    return rows.select(lsn.cast("long").alias("lsn"), F.lit(name).alias("table"), op.alias("op"), row_id.alias("row_id"),
                       F.explode(F.array(payload(name))).alias("payload"))


def _parsed(feed: DataFrame, name: str) -> DataFrame:
    schema = T.StructType([*SCHEMAS[name].fields, T.StructField("_bad", T.StringType())])
    image = F.from_json("payload", schema, TIMES | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    # a generated column: a condition on it is not pushed below it, where the text would be parsed once more
    return feed.where(F.col("table") == name).select("*", F.explode(F.array(image)).alias("_image"))


def typed(feed: DataFrame, name: str) -> DataFrame:
    """The changes of one table: its columns, ``lsn`` and ``op``."""
    rows = _parsed(feed, name).where("_image._bad is null and payload is not null")
    own = [F.col("row_id").alias(ROW_ID)] if KEYS[name] == [ROW_ID] else []
    return rows.select(*own, *[F.col(f"_image.{c}").alias(c) for c in SCHEMAS[name].names], "lsn", "op")


def rejected(feed: DataFrame) -> DataFrame:
    """Feed rows of an unknown table or whose payload does not fit their table's schema."""
    out = feed.where(~F.coalesce(F.col("table").isin(list(SCHEMAS)), F.lit(False))).select(*FEED_SCHEMA.names)
    for name in SCHEMAS:
        bad = _parsed(feed, name).where("_image._bad is not null or payload is null")
        out = out.unionByName(bad.select(*FEED_SCHEMA.names))
    return out


def copied(rows: DataFrame, name: str, position: int) -> DataFrame:
    """An initial copy: every row as of the hand-over position."""
    return (rows.select(*columns(name)).withColumn("_lsn", F.lit(position).cast("long")).withColumn("_deleted", F.lit(False)))


def merged(copy: DataFrame, feed_rows: DataFrame, name: str, position: int) -> DataFrame:
    """Copy and typed changes after ``position`` as one state (tombstones included)."""
    return apply_changes(copy, feed_rows.where(F.col("lsn") > position), KEYS[name], digest=KEYS[name] == [ROW_ID])


def table_of(state: DataFrame, name: str) -> DataFrame:
    """What a reader sees of a state: the table's declared columns."""
    return visible(state).select(*SCHEMAS[name].names)


class Replica:
    """Replicas of the base tables below one shared folder.

    ``copy/<table>/<version>`` holds the copies, ``changes/<batch>/table=<name>``
    the changes of each streamed batch, ``handover.json`` the current version
    and the positions of each table's copy.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.handover_path = os.path.join(root, "handover.json")

    def handover(self) -> dict:
        """table -> {"path", "started", "ended"}"""
        text = fsio.read_text(self.spark, self.handover_path)
        return json.loads(text) if text else {}

    def _commit(self, name: str, state: DataFrame, started: int, ended: int) -> None:
        path = os.path.join(self.root, "copy", name, uuid.uuid4().hex)
        state.write.parquet(path)
        entries = self.handover()
        entries[name] = {"path": path, "started": started, "ended": ended}
        fsio.mkdirs(self.spark, self.root)
        fsio.write_text_atomic(self.spark, self.handover_path, json.dumps(entries, sort_keys=True))

    def copy(self, name: str, rows: DataFrame, started: int, ended: int | None = None) -> None:
        """Initial copy of a table.  ``started``: the source's position before
        the first row was read; ``ended``: after the last one (equal for a
        copy of one consistent snapshot)."""
        self._commit(name, copied(rows, name, started), started, started if ended is None else ended)

    def state(self, name: str) -> DataFrame:
        entry = self.handover()[name]
        copy = self.spark.read.schema(copied(self._empty(name), name, 0).schema).parquet(entry["path"])
        return merged(copy, self.changes(name), name, entry["started"])

    def read(self, name: str) -> DataFrame:
        return table_of(self.state(name), name)

    def tables(self) -> dict[str, DataFrame]:
        """The replicated tables, as the reports take them."""
        return {name: self.read(name) for name in self.handover()}

    def _empty(self, name: str) -> DataFrame:
        own = [T.StructField(ROW_ID, T.StringType())] if KEYS[name] == [ROW_ID] else []
        return self.spark.createDataFrame([], T.StructType([*own, *SCHEMAS[name].fields]))

    def changes(self, name: str) -> DataFrame:
        """All streamed changes of a table, typed."""
        schema = typed(self.spark.createDataFrame([], FEED_SCHEMA), name).schema
        base = os.path.join(self.root, "changes")
        folders = [os.path.join(base, batch, f"table={name}") for batch in fsio.list_dirs(self.spark, base)]
        folders = [f for f in folders if fsio.exists(self.spark, f)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        raw = self.spark.read.schema(T.StructType([f for f in FEED_SCHEMA.fields if f.name != "table"])).parquet(*folders)
        return typed(raw.withColumn("table", F.lit(name)), name)

    def store(self, batch: DataFrame, name: str) -> None:
        """The changes of a batch, by table; the same batch again replaces them."""
        path = os.path.join(self.root, "changes", name)
        batch.select(*FEED_SCHEMA.names).write.mode("overwrite").partitionBy("table").parquet(path)

    def lagging(self) -> list[str]:
        """Tables whose changes have not yet reached the position at which their copy ended."""
        out = []
        for name, entry in self.handover().items():
            if entry["ended"] > entry["started"]:
                reached = self.changes(name).agg(F.max("lsn")).first()[0]
                if reached is None or reached < entry["ended"]:
                    out.append(name)
        return out

    def compact(self, name: str) -> None:
        """The merge of copy and changes becomes the copy; its rows keep their LSNs."""
        entry = self.handover()[name]
        self._commit(name, self.state(name), entry["started"], entry["ended"])

    def start(self, source_dir: str, checkpoint: str, publish: tuple[str, ...] = ("insert", "update", "delete"),
              resend_window: str = "1 hour", available_now: bool = True, processing_time: str = "30 seconds"):
        """Structured Streaming job: feed files -> duplicates dropped -> changes by table.

        ``resend_window``: how long after its first arrival a change that is
        sent again is dropped by the stream; later ones are stored again and
        change nothing, as they are not newer than their key."""
        for key, value in STATE_STORE.items():
            self.spark.conf.set(key, value)
        feed = self.spark.readStream.schema(FEED_SCHEMA).parquet(source_dir)
        arrived = feed.withColumn("_arrived", F.col("_metadata.file_modification_time"))
        # the same change has the same table, LSN and image
        once = (filter_ops(arrived, publish).withColumn("_digest", F.xxhash64("op", "row_id", "payload"))
                .withWatermark("_arrived", resend_window).dropDuplicatesWithinWatermark(["table", "lsn", "_digest"]))
        stream = os.path.basename(os.path.normpath(checkpoint))
        w = once.writeStream.foreachBatch(lambda batch, number: self.store(batch, f"{stream}-{number}")).option("checkpointLocation", checkpoint)
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
        return w.start()
