"""Distinct counts that add up: bitmaps of dense ids.

``COUNT(DISTINCT id)`` of a month cannot be made from the counts of its days.  A
bitmap of the ids can: ``bitmaps`` builds, per group and block of 64 ids, one
64-bit word; words of finer groups are merged into coarser ones by OR, and the
bits counted.  Bitmaps of closed days are stored once and every later week,
month or year is made of them without reading the facts again.

A group stores a word for every block that holds one of its ids: never more
words than rows, and one for 64 ids where they are dense.  Words are longs, so
all aggregates are hashed in fixed-width buffers.  NULL ids are not counted;
negative ids have blocks of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, BITS = "_block", "_bits"


def bitmaps(df: DataFrame, by: list[str | Column], id_col: str) -> DataFrame:
    """One row per group and block of ids: ``by``, the block and its word."""
    keys = [F.col(c) if isinstance(c, str) else c for c in by]
    rows = df.where(F.col(id_col).isNotNull()).select(
        *keys, F.shiftright(F.col(id_col).cast("long"), 6).alias(BLOCK), F.expr(f"shiftleft(1L, cast(pmod(`{id_col}`, 64) as int))").alias("_bit"))
    names = [c for c in rows.columns if c != "_bit"]
    return rows.groupBy(*names).agg(F.bit_or("_bit").alias(BITS))


def merge(maps: DataFrame, by: list[str | Column]) -> DataFrame:
    """Bitmaps of coarser groups."""
    keys = [F.col(c) if isinstance(c, str) else c for c in by]
    rows = maps.select(*keys, BLOCK, BITS)
    return rows.groupBy(*[c for c in rows.columns if c != BITS]).agg(F.bit_or(BITS).alias(BITS))


def cardinality(maps: DataFrame, name: str) -> DataFrame:
    """Distinct ids of every group."""
    by = [c for c in maps.columns if c not in (BLOCK, BITS)]
    return maps.groupBy(*by).agg(F.sum(F.bit_count(BITS)).cast("long").alias(name))
