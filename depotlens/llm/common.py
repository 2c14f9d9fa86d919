"""Helpers the training-data operators share: table access, written tables in
the shared folder, and connected components of a link table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root

WORD = r"[^\x20\x09-\x0D]+"
HOLDOUT_FOLDS = 5
TEXT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id") -> Column:
    """True for documents no model may learn from: crc32(id as text) mod 5 is 0 (null id: held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HOLDOUT_FOLDS == 0, F.lit(True))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read
    again: cuts the lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = checkpoint_root(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_texts(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` for rows that hold texts.  The default of 10,000 rows
    a batch is meant for narrow rows; the session's setting is lowered to
    TEXT_ROWS, so that a batch of long texts (on both sides of the pipe) and
    what is made of it stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key, "10000")) <= TEXT_ROWS:
        df.sparkSession.conf.set(key, str(TEXT_ROWS))
    return df.mapInArrow(fn, schema)


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """The least row of each key, by the other columns in their order."""
    rest = [c for c in df.columns if c != key]
    if not rest:
        return df.distinct()
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("least")).select(key, "least.*")


def hashed_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """About ``n`` rows of ``df`` (all, if it has fewer), one per key: those
    whose hash of ``key`` is below a bound.  A count and a filter, the same
    rows on every run and for every partitioning, spread over the tasks that
    read them; a key of very many rows adds one."""
    rows = df.count()
    bound = (1 << 32) if rows <= n else (1 << 32) * n // rows
    return one_per_key(df.where(F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1 << 32)) < bound), key)


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``links(a, b)`` that has a link to
    another node; ``root`` is the smallest node of the component.

    Alternating large-star and small-star rounds: every round replaces links
    by links to the smallest known neighbour, so a chain halves per round.
    Minima are taken by partial aggregates and joined back (a hub with a third
    of all links is split by the skew join); each round is a written table.
    Null ends and self-links are ignored; an empty table gives no rows.
    """
    e = (links.where(F.col(a) != F.col(b))
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    e = written(e, "links")
    sig = _signature(e)
    while sig[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = written(small, "links")
        new = _signature(e)
        if new == sig:
            break
        sig = new
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
