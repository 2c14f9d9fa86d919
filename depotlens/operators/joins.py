"""Joins of large tables that behave alike at every size.

No side is hinted to be broadcast and nothing is counted while a plan is
built: whether a side is small enough is left to the planner, which knows its
size (statically, or at run time through adaptive execution).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prune_at_run_time
from ..sources.monthly import MONTH

NULL_SPREAD = 1024  # partitions' worth of keys that rows with a NULL key are spread over


def restrict_to_keys(big: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``big`` whose key occurs in ``keys``.  Below an aggregation
    on the same key this prunes a long history to what a date-filtered parent
    needs, at the price of a join instead of an aggregation of everything.

    ``keys`` are of dated parents: in the monthly layout the month is part of
    the join, which lets Spark prune the partitions of ``big`` at run time.  In
    every layout a Bloom filter of the keys drops most other rows of ``big``
    before they are shuffled."""
    prune_at_run_time(big.sparkSession)
    on = [key] + [MONTH] * (MONTH in big.columns and MONTH in keys.columns)
    return big.join(keys.select(*on).where(F.col(key).isNotNull()), on, "left_semi")


def lookup(fact: DataFrame, dim: DataFrame, on: str, how: str = "left") -> DataFrame:
    """``fact JOIN dim`` for an N:1 lookup on a key that may be NULL.

    Rows with a NULL key match nothing, but a shuffle join would send all of
    them to one task; a second key that is 0 for every real key and a hash of
    the row for NULL keys spreads them.  It is part of the join's condition
    and no column, so neither side's rows get wider.
    """
    f, d = [lambda c, side=side: F.col(f"{side}.`{c}`") for side in ("_fact", "_dim")]
    spread = F.when(f(on).isNull(), 1 + F.pmod(F.xxhash64(*[f(c) for c in fact.columns]), F.lit(NULL_SPREAD))).otherwise(F.lit(0))
    zero = F.pmod(F.hash(d(on)), F.lit(1))  # always 0, but no constant that the optimizer would fold out of the join
    j = fact.alias("_fact").join(dim.alias("_dim"), (f(on) == d(on)) & (spread.cast("int") == zero), how)
    return j.select(f(on), *[f(c) for c in fact.columns if c != on], *[d(c) for c in dim.columns if c != on])


def left_join_many(one: DataFrame, many: DataFrame, key: str) -> DataFrame:
    """``one LEFT JOIN many`` where ``many`` may hold most rows under one key.

    Of a left join Spark splits only the left side of a skewed partition; of an
    inner join either.  So the matches are an inner join, and the rows without
    one are found by an anti-join against the distinct keys, which are reduced
    before they are shuffled.
    """
    keys = many.select(key).where(F.col(key).isNotNull()).distinct()
    alone = one.join(keys, key, "left_anti")
    return one.join(many, key, "inner").unionByName(alone, allowMissingColumns=True)
