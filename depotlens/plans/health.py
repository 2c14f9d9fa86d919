"""Health reports over tables of collected samples (instead of live catalogs).

* ``replication_lag`` (O1): per sample of the four log positions of a
  replica connection, the byte lag of each stage, an estimated lag in 16 MB
  segments ("minutes") and a pretty size.
* ``slow_queries_topk`` (O2): calls / total / mean time per statement from a
  query log, top 20 by mean time (the LIMIT is the feature).
* ``column_profile`` (O3): per column of every base table: rows, NULLs,
  distinct values and every repeated value with its count.
* ``table_dml_counts`` (O4) lives in ``streaming.cdc``.

Fixture inputs are derived from ``events`` by Spark (see FIXTURES.md).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import BIG, lsn_to_long, round2, size_pretty
from ..functions.rules import LAG_SEGMENT_BYTES
from ..sources.tables import SCHEMAS, Tables
from ..sources.tables_meta import TABLE_SCHEMA

SEGMENT = 1 << 24  # fixture: one log segment of position per event id


def _lsn_text(pos: Column) -> Column:
    """byte position -> 'HI/LO' upper-case hex text."""
    return F.format_string("%X/%X", F.shiftright(pos, 32), pos.bitwiseAND(F.lit(0xFFFFFFFF)))


def lag_samples(events: DataFrame) -> DataFrame:
    """Fixture samples: one per event, positions derived from its columns."""
    cur = (F.col("event_id") + 16) * SEGMENT + F.col("user_id") * 1000  # positions stay positive
    sent = cur - (F.col("value") * 1000).cast("long")
    write = sent - (F.col("event_id") % 7) * 4096
    flush = write - F.col("user_id") * 10
    replay = flush - (F.col("value") * 100).cast("long")
    return events.select(F.col("event_id").alias("sample_id"), F.col("ts").alias("sample_ts"),
                         *[_lsn_text(c).alias(n) for c, n in [(cur, "current_lsn"), (sent, "sent_lsn"),
                                                             (write, "write_lsn"), (flush, "flush_lsn"),
                                                             (replay, "replay_lsn")]])


def replication_lag(samples: DataFrame) -> DataFrame:
    """O1 over samples (sample_id, sample_ts, current/sent/write/flush/replay_lsn)."""
    cur, sent, write, flush, replay = (lsn_to_long(F.col(c)) for c in
                                       ("current_lsn", "sent_lsn", "write_lsn", "flush_lsn", "replay_lsn"))
    total = cur - replay
    return samples.select(
        "sample_id", "sample_ts",
        (cur - sent).cast("long").alias("sent_lag_bytes"), (sent - write).cast("long").alias("write_lag_bytes"),
        (write - flush).cast("long").alias("flush_lag_bytes"), (flush - replay).cast("long").alias("replay_lag_bytes"),
        F.when(total > 0, round2(total.cast(BIG) * 100, F.lit(LAG_SEGMENT_BYTES))).otherwise(F.lit(0.0))
        .alias("estimated_lag_minutes"),
        size_pretty(total).alias("lag_size"))


def query_log(events: DataFrame) -> DataFrame:
    """Fixture query log: statement = event_type, duration in ms = value."""
    return events.select(F.col("event_type").alias("query"), F.col("value").alias("time_ms"))


def slow_queries_topk(log: DataFrame, k: int = 20) -> DataFrame:
    """O2: top ``k`` statements by mean time (ties by statement text).

    Times are summed exactly in hundredths of a ms; one partial aggregation
    per statement, then ``orderBy().limit(k)`` (TakeOrderedAndProject: each
    partition keeps k rows, only k*partitions rows reach the final merge).
    """
    hund = F.round(F.col("time_ms") * 100).cast("long")
    g = log.groupBy("query").agg(F.count(F.lit(1)).alias("calls"), F.sum(hund).alias("_h"),
                                 F.count(hund).alias("_n"))
    out = g.select("query", "calls", (F.col("_h").cast("double") / 100.0).alias("total_time"),
                   (F.col("_h").cast("double") / 100.0 / F.col("_n")).alias("mean_time"))
    return out.orderBy(F.col("mean_time").desc_nulls_last(), F.col("query")).limit(k)


def _columns() -> list[tuple[int, str, str, str]]:
    """(column id, schemaname, tablename, attname) of every base-table column."""
    out = []
    for name, schema in SCHEMAS.items():
        for f in schema.fields:
            out.append((len(out), TABLE_SCHEMA[name], name, f.name))
    return out


def _stacked(t: Tables) -> DataFrame:
    """(column id, value text) for every cell of every table; a small integer
    id keeps the aggregation key short (names are joined back at the end)."""
    ids = {(tn, an): cid for cid, _, tn, an in _columns()}
    parts = []
    for name, schema in SCHEMAS.items():
        cells = F.array(*[F.struct(F.lit(ids[(name, f.name)]).alias("cid"),
                                   F.col(f.name).cast("string").alias("value")) for f in schema.fields])
        parts.append(t[name].select(F.inline(cells)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_profile(t: Tables) -> DataFrame:
    """O3: per column rows, null_count and n_distinct, with every value that
    occurs more than once, how often (n) and its share of the rows (frequency).

    A row per column and repeated value; a column without any has one row with
    a NULL value.  Nothing is ranked, cut or sampled: value counts come from
    one partial aggregation over the cells and stay spread over the tasks.
    """
    counts = _stacked(t).groupBy("cid", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("cid").agg(
        F.sum("n").cast("long").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("null_count"),
        F.count("value").alias("n_distinct"))
    repeated = counts.where(F.col("value").isNotNull() & (F.col("n") > 1))
    names = t[next(iter(SCHEMAS))].sparkSession.createDataFrame(
        _columns(), "cid int, schemaname string, tablename string, attname string")
    # totals and names have a row per column of the schema
    heads = F.broadcast(totals.join(F.broadcast(names), "cid"))
    # repeated values stay where they are; a shuffle on the column would send all of a column's to one task
    without = heads.join(repeated.select("cid").distinct(), "cid", "left_anti")
    return repeated.join(heads, "cid").unionByName(without, allowMissingColumns=True).select(
        "schemaname", "tablename", "attname", "rows", "null_count", "n_distinct", "value", "n",
        (F.col("n") / F.col("rows")).alias("frequency"))
