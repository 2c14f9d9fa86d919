"""Fixture of a replication: what an initial copy saw of the twelve tables, and
the change feed that leads from there to the tables as they are.

Every row is dealt to a tenth by a hash of its key, which decides its history:

=====  ========================================================================
tenth  history
=====  ========================================================================
0, 1   copied with an old image, then updated
2      copied; another key was copied too and is deleted by the feed
3      changed while the copy ran: copied with its last image, and the feed
       has both changes
4      copied; the feed has an older change that the copy already holds
5      copied; another key is inserted and deleted by the feed
6      copied, no change
7-8    inserted by the feed, one of them sent twice
9      inserted with an old image, then updated
=====  ========================================================================

An old image has NULL in every column but the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..streaming import replica as R
from .fixtures import FixtureTables
from .tables import SCHEMAS

STARTED, ENDED = 2 << 40, 3 << 40  # positions read before and after the copy
BEFORE, DURING, AFTER, LATER = 1 << 40, (2 << 40) + (1 << 39), 4 << 40, 5 << 40


def identified(t: FixtureTables, name: str) -> DataFrame:
    """A fixture table with the row id its replica needs."""
    if R.KEYS[name] != [R.ROW_ID]:
        return t[name].select(*SCHEMAS[name].names)
    raw = t.raw["lineitem"]
    row_id = F.concat_ws("-", *[F.col(c).cast("string") for c in raw.columns])
    rows = t.mapped(name, raw.withColumn(R.ROW_ID, row_id))
    return rows.select(R.ROW_ID, *[F.col(f.name).cast(f.dataType) for f in SCHEMAS[name].fields])


def tenth(name: str) -> Column:
    return F.pmod(F.xxhash64(*R.KEYS[name]), F.lit(10))


def _other(rows: DataFrame, name: str) -> Column:
    """A key that no row has."""
    key = R.KEYS[name][0]
    text = isinstance(rows.schema[key].dataType, T.StringType)
    return F.concat(F.lit("gone-"), F.col(key)) if text else -1 - F.col(key)


def _told(rows: DataFrame, name: str, histories: list[list[tuple]], fields: str) -> DataFrame:
    """Every row once for each entry of its tenth's history, all from one pass
    over the rows: ``fields`` of the entry, among them ``old`` (NULL in every
    column but the key) and ``other`` (under the key that no row has)."""
    own = T.StructType.fromDDL(fields)
    entries = F.array(*[F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(own.fields, e)]) for e in h])
                        .cast(T.ArrayType(own)) for h in histories])
    first, kinds = R.KEYS[name][0], {f.name: f.dataType for f in rows.schema.fields}
    told = rows.select("*", F.inline(F.element_at(entries, (tenth(name) + 1).cast("int"))))
    told = told.withColumn(first, F.when(F.col("other"), _other(rows, name)).otherwise(F.col(first)))
    image = lambda c: F.when(~F.col("old"), F.col(c)).cast(kinds[c])
    return told.withColumns({c: image(c) for c in R.columns(name) if c not in R.KEYS[name]})


def copy_of(t: FixtureTables, name: str) -> DataFrame:
    """What the initial copy read."""
    row, old, other = (False, False), (True, False), (False, True)
    seen = [[old]] * 2 + [[row, other]] + [[row]] * 4 + [[]] * 3
    return _told(identified(t, name), name, seen, "old boolean, other boolean").select(*R.columns(name))


def feed_of(t: FixtureTables, name: str) -> DataFrame:
    """The changes of one table, some before the copy and some sent twice."""
    row, old, other, gone = (False, False), (True, False), (False, True), (True, True)
    sent = [[("U", AFTER, *row)]] * 2 + [
        [("D", AFTER, *other)],
        [("U", DURING, *old), ("U", AFTER, *row)],
        [("U", BEFORE, *old)],
        [("I", AFTER, *other), ("D", LATER, *gone)],
        [],
        [("I", AFTER, *row)],
        [("I", AFTER, *row)] * 2,
        [("I", AFTER, *old), ("U", LATER, *row)]]
    rows = _told(identified(t, name), name, sent, "op string, after long, old boolean, other boolean")
    lsn = F.col("after") + F.pmod(F.xxhash64(*R.KEYS[name]), F.lit(1 << 38))
    return R.changes(rows, name, F.col("op"), lsn, F.col(R.ROW_ID) if R.KEYS[name] == [R.ROW_ID] else None)


def feed(t: FixtureTables, names: list[str] | None = None) -> DataFrame:
    """One feed for all tables (or ``names``)."""
    out = None
    for name in names or list(SCHEMAS):
        part = feed_of(t, name)
        out = part if out is None else out.unionByName(part)
    return out
