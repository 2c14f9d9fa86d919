"""Keyed snapshots of the M-reports: materialise, key check, diff, refresh groups,
export with retention.

Layout under a *shared* root (default: ``<spark.checkpoint.dir>/snapshots``)::

    <root>/<name>/v=<version>/part-*.parquet      one folder per refresh
    <root>/_manifest.json                           {name: version} readers use

A refresh computes every member of its group, writes each to a new version
folder, checks the unique key on the written files, and only then replaces
the manifest in one rename on the shared file system (``fsio``) -- so readers
see either all old or all new
versions of the group (the reference runs its three REFRESH statements in one
function call, i.e. one transaction).  Reading back from the written files
also cuts the lineage of every snapshot.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root
from ..sources.tables import Tables
from . import fsio

# Refresh groups and their cadence (cron: daily 02:00, Monday
# 03:00, first of month 04:00), and the unique keys of the snapshots.
GROUPS: dict[str, list[str]] = {
    "daily": ["m1_daily_warehouse_summary", "m5_product_movement_30days", "m6_daily_shipping_receiving"],
    "weekly": ["m3_weekly_order_summary"],
    "monthly": ["m2_monthly_inventory_summary", "m4_customer_lifetime_value"],
}
SCHEDULE = {"daily": dt.time(2, 0), "weekly": dt.time(3, 0), "monthly": dt.time(4, 0)}
UNIQUE_KEYS: dict[str, tuple[str, ...]] = {
    "m1_daily_warehouse_summary": ("summary_date", "warehouse_id"),
    "m2_monthly_inventory_summary": ("summary_month", "product_id"),
    "m3_weekly_order_summary": ("summary_week", "warehouse_id"),
    "m4_customer_lifetime_value": ("summary_month", "customer_id"),
    "m5_product_movement_30days": ("summary_date", "product_id"),
    "m6_daily_shipping_receiving": ("summary_date", "warehouse_id", "activity_type"),
}


def builders() -> dict[str, Callable[[Tables, dt.date], DataFrame]]:
    from ..plans import customers, inventory, orders, warehouse
    return {
        "m1_daily_warehouse_summary": warehouse.daily_warehouse_summary,
        "m2_monthly_inventory_summary": inventory.monthly_inventory_summary,
        "m3_weekly_order_summary": orders.weekly_order_summary,
        "m4_customer_lifetime_value": customers.customer_lifetime_value,
        "m5_product_movement_30days": inventory.product_movement_30days,
        "m6_daily_shipping_receiving": warehouse.daily_shipping_receiving,
    }


# --- key checks -----------------------------------------------------------------

def duplicate_keys(df: DataFrame, key: tuple[str, ...] | list[str]) -> DataFrame:
    """Key values held by more than one row.  Rows with a NULL key component
    are exempt, as in a SQL unique index (NULLs are distinct)."""
    not_null = None
    for k in key:
        c = F.col(k).isNotNull()
        not_null = c if not_null is None else not_null & c
    return (df.where(not_null).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))


def key_stats(df: DataFrame, key: tuple[str, ...] | list[str], name: str) -> DataFrame:
    """One row: snapshot name, rows, rows with a NULL key part, duplicated keys.

    Two partial aggregations (per key, then global); the per-key one is the
    only shuffle and a hot key is combined map-side.
    """
    any_null = None
    for k in key:
        c = F.col(k).isNull()
        any_null = c if any_null is None else any_null | c
    per_key = (df.select(*key, any_null.alias("_null"))
               .groupBy(*key, "_null").agg(F.count(F.lit(1)).alias("n")))
    return per_key.agg(
        F.lit(name).alias("snapshot"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("_null"), F.col("n"))), F.lit(0)).cast("long").alias("null_key_rows"),
        F.count(F.when(~F.col("_null") & (F.col("n") > 1), F.lit(1))).alias("duplicate_keys"))


def base_key_stats(t: Tables, keys: dict[str, tuple[str, ...] | list[str]]) -> DataFrame:
    """One row per table of ``keys``: rows, rows with a NULL key part, duplicated keys."""
    out = None
    for name, key in keys.items():
        st = key_stats(t[name], key, name).withColumnRenamed("snapshot", "table_name")
        out = st if out is None else out.unionByName(st)
    return out


def lines_of_many_orders(order_items: DataFrame) -> DataFrame:
    """One row: distinct line ids, and those that occur under more than one
    order.  V3 and M3 sum distinct lines over orders, which counts the latter
    more than once; there must be none."""
    per = order_items.where(F.col("order_item_id").isNotNull()).groupBy("order_item_id").agg(
        F.min("order_id").alias("low"), F.max("order_id").alias("high"))
    return per.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("low") < F.col("high")).alias("lines_of_many_orders"))


class DuplicateKeyError(ValueError):
    pass


class RefreshConflict(RuntimeError):
    """A snapshot of the group was committed by another refresh."""


def assert_unique(df: DataFrame, key, name: str = "snapshot") -> None:
    bad = duplicate_keys(df, key).limit(5).collect()  # at most 5 rows reach the driver
    if bad:
        raise DuplicateKeyError(f"{name}: duplicate key values {bad}")


# --- diff ---------------------------------------------------------------------------

def diff(old: DataFrame, new: DataFrame, key: list[str], compare: list[str] | None = None) -> DataFrame:
    """Row-level changes from ``old`` to ``new`` on ``key``: op insert/delete/update.

    Unchanged rows are omitted.  Values compare with ``<=>`` (NULL equals NULL).
    One full outer join on the key; keys are unique on both sides, so no key
    is hot.
    """
    compare = compare or [c for c in new.columns if c not in key]
    o = old.select(*[F.col(k).alias(f"_k_{k}") for k in key], *[F.col(c).alias(f"_o_{c}") for c in compare],
                   F.lit(True).alias("_in_old"))
    n = new.select(*[F.col(k).alias(f"_n_{k}") for k in key], *[F.col(c).alias(f"_v_{c}") for c in compare],
                   F.lit(True).alias("_in_new"))
    cond = None
    for k in key:
        c = F.col(f"_k_{k}").eqNullSafe(F.col(f"_n_{k}"))
        cond = c if cond is None else cond & c
    j = o.join(n, cond, "full")
    same: Column | None = None
    for c in compare:
        e = F.col(f"_o_{c}").eqNullSafe(F.col(f"_v_{c}"))
        same = e if same is None else same & e
    changed = F.lit(False) if same is None else ~same
    op = (F.when(F.col("_in_old").isNull(), F.lit("insert"))
           .when(F.col("_in_new").isNull(), F.lit("delete"))
           .when(changed, F.lit("update")))
    return j.select(*[F.coalesce(F.col(f"_n_{k}"), F.col(f"_k_{k}")).alias(k) for k in key], op.alias("op")) \
            .where(F.col("op").isNotNull())


def apply_diff(old: DataFrame, changes: DataFrame, new_rows: DataFrame, key: list[str]) -> DataFrame:
    """old - (deleted + updated keys) + (inserted + updated rows from new_rows)."""
    touched = changes.select(*key)
    kept = old.join(touched, [old[k].eqNullSafe(touched[k]) for k in key], "left_anti")
    upserts = changes.where(F.col("op") != "delete").select(*key)
    added = new_rows.join(upserts, [new_rows[k].eqNullSafe(upserts[k]) for k in key], "left_semi")
    return kept.unionByName(added)


# --- store, manifest, refresh ----------------------------------------------------------

def default_root(spark: SparkSession) -> str:
    return checkpoint_root(spark, "snapshots")


def _manifest_path(root: str) -> str:
    return os.path.join(root, "_manifest.json")


def read_manifest(root: str, spark: SparkSession | None = None) -> dict:
    spark = spark or SparkSession.getActiveSession()
    text = fsio.read_text(spark, _manifest_path(root))
    return json.loads(text) if text else {}


def _swap_manifest(spark: SparkSession, root: str, manifest: dict) -> None:
    fsio.write_text_atomic(spark, _manifest_path(root), json.dumps(manifest, sort_keys=True))  # commit point


def read_snapshot(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    root = root or default_root(spark)
    entry = read_manifest(root, spark).get(name)
    if entry is None:
        raise KeyError(f"no committed snapshot {name!r} under {root}")
    return spark.read.parquet(os.path.join(root, name, f"v={entry['version']}"))


def materialize(spark: SparkSession, df: DataFrame, name: str, root: str | None = None,
                key: tuple[str, ...] | None = None) -> tuple[str, DataFrame]:
    """Write ``df`` as a new version folder of ``name`` (not yet committed),
    check its unique key on the written files and return (version, reread).
    An empty ``key`` leaves the check to the caller."""
    root = root or default_root(spark)
    version = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:8]
    path = os.path.join(root, name, f"v={version}")
    df.write.mode("errorifexists").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    key = UNIQUE_KEYS.get(name) if key is None else key
    if key:
        assert_unique(written, key, name)
    return version, written


def check_and_diff(old: DataFrame | None, new: DataFrame, key: list[str]) -> dict[str, int]:
    """Rows and duplicated keys of ``new`` and the number of inserted, updated
    and deleted rows, from one grouping of both by key: one shuffle, one job.

    Keys with a NULL part may repeat, as in a SQL unique index; in the diff they
    are equal.  Values compare with NULL equal to NULL."""
    rest = [c for c in new.columns if c not in key] or key[:1]
    side = lambda df, fresh: df.select(*key, F.struct(*rest).alias("row"), F.lit(fresh).alias("fresh"))
    both = side(new, True) if old is None else side(new, True).unionByName(side(old, False))
    fresh = F.col("fresh")
    per = both.groupBy(*key).agg(F.count_if(fresh).alias("n"), F.count_if(~fresh).alias("was"),
                                 F.max(F.when(fresh, F.col("row"))).alias("now"), F.max(F.when(~fresh, F.col("row"))).alias("then"))
    whole = None
    for k in key:
        whole = F.col(k).isNotNull() if whole is None else whole & F.col(k).isNotNull()
    n, was = F.col("n"), F.col("was")
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(whole & (n > 1)).alias("duplicates"), F.count_if(was == 0).alias("insert"), F.count_if(n == 0).alias("delete"),
                   F.count_if((n > 0) & (was > 0) & ~F.col("now").eqNullSafe(F.col("then"))).alias("update")).first().asDict()


def refresh(spark: SparkSession, tables: Tables, group: str = "daily", as_of: dt.date | None = None,
            root: str | None = None) -> dict:
    """Refresh every snapshot of ``group`` (daily|weekly|monthly) at ``as_of``
    and commit them together.  Returns {name: {version, rows, changes}}."""
    if group not in GROUPS:
        raise ValueError(f"unknown refresh group {group!r}; expected one of {sorted(GROUPS)}")
    if as_of is None:
        raise ValueError("as_of is required (reports never read the wall clock)")
    root = root or default_root(spark)
    build = builders()
    manifest = read_manifest(root, spark)
    staged, report = {}, {}
    for name in GROUPS[group]:
        version, written = materialize(spark, build[name](tables, as_of), name, root, ())
        info = {"version": version, "as_of": as_of.isoformat()}
        plain = lambda df: df.drop(*[k for k in df.columns if k.startswith("summary_")])
        old = None
        if name in manifest:
            old = plain(spark.read.parquet(os.path.join(root, name, f"v={manifest[name]['version']}")))
        # the summary date is the same in all rows of a version
        found = check_and_diff(old, plain(written), [k for k in UNIQUE_KEYS[name] if not k.startswith("summary_")])
        info["rows"] = found.pop("rows")
        if found.pop("duplicates"):
            assert_unique(written, UNIQUE_KEYS[name], name)  # raises, and names some
        if old is not None:
            info["changes"] = {op: n for op, n in found.items() if n}
        staged[name] = {"version": version, "as_of": info["as_of"]}
        report[name] = info
    # another group may have committed meanwhile: merge into what is committed now, refuse to overwrite a newer version
    latest = read_manifest(root, spark)
    lost = [name for name in staged if latest.get(name) != manifest.get(name)]
    if lost:
        raise RefreshConflict(f"refreshed by someone else meanwhile: {lost}; run the group again")
    _swap_manifest(spark, root, latest | staged)
    return report


def prune_versions(spark: SparkSession, root: str | None = None, keep: int = 3) -> list[str]:
    """Delete version folders of each snapshot except the committed one and
    the ``keep`` newest; returns the deleted folder names.  Run after a
    refresh; readers only ever follow the manifest."""
    root = root or default_root(spark)
    manifest = read_manifest(root, spark)
    gone = []
    for name in UNIQUE_KEYS:
        versions = sorted(v for v in fsio.list_dirs(spark, os.path.join(root, name)) if v.startswith("v="))
        live = {f"v={manifest[name]['version']}"} if name in manifest else set()
        for v in versions[:-keep] if keep > 0 else versions:
            if v not in live:
                fsio.delete(spark, os.path.join(root, name, v))
                gone.append(f"{name}/{v}")
    return gone


def due(ts: Column) -> Column:
    """``due_groups`` of a timestamp column: the array of groups due in its hour."""
    on = {"daily": F.lit(True), "weekly": F.weekday(ts) == 0, "monthly": F.dayofmonth(ts) == 1}
    names = [F.when((F.hour(ts) == at.hour) & on[g], F.lit(g)) for g, at in SCHEDULE.items()]
    return F.array_compact(F.array(*names))


def due_groups(ts: dt.datetime) -> list[str]:
    """Groups whose scheduled run falls in the hour starting at ``ts``'s hour."""
    out = []
    for g, at in SCHEDULE.items():
        if ts.hour != at.hour:
            continue
        if g == "weekly" and ts.weekday() != 0:
            continue
        if g == "monthly" and ts.day != 1:
            continue
        out.append(g)
    return out


# --- export with retention ----------------------------------------------------------

def export_snapshot(spark: SparkSession, df: DataFrame, export_root: str, name: str, as_of: dt.date,
                    retention_days: int = 30) -> str:
    """Write ``df`` compressed under ``export_root/dt=<as_of>/<name>`` and drop
    ``dt=`` partitions older than ``as_of - retention_days``; returns the folder
    written.  Works on any Hadoop file system."""
    path = commit_export(spark, df, export_root, name, as_of)
    expire_partitions(spark, export_root, as_of, retention_days)
    return path


def _export_folder(export_root: str, name: str, as_of: dt.date) -> str:
    return os.path.join(export_root, f"dt={as_of.isoformat()}", name)


def commit_export(spark: SparkSession, df: DataFrame, export_root: str, name: str, as_of: dt.date) -> str:
    """Every run writes a folder of its own; the pointer ``_current`` is replaced
    when it is complete.  A run that dies leaves the export before it readable,
    and two runs cannot mix.  Runs that are neither current nor the one before
    are deleted, but not while they may still be written (a day)."""
    folder = _export_folder(export_root, name, as_of)
    pointer = os.path.join(folder, "_current")
    before = fsio.read_text(spark, pointer)
    run = "run=" + dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:8]
    path = os.path.join(folder, run)
    df.write.mode("errorifexists").option("compression", "gzip").parquet(path)
    fsio.write_text_atomic(spark, pointer, run)
    limit = (dt.datetime.now(dt.timezone.utc) - dt.timedelta(days=1)).strftime("run=%Y%m%dT%H%M%S")
    for old in fsio.list_dirs(spark, folder):
        if old not in (run, before) and old < limit:
            fsio.delete(spark, os.path.join(folder, old))
    return path


def read_export(spark: SparkSession, export_root: str, name: str, as_of: dt.date) -> DataFrame:
    """The committed export of a day."""
    folder = _export_folder(export_root, name, as_of)
    run = fsio.read_text(spark, os.path.join(folder, "_current"))
    if run is None:
        raise KeyError(f"no export of {name!r} on {as_of} under {export_root}")
    return spark.read.parquet(os.path.join(folder, run))


def export_reports(spark: SparkSession, tables: Tables, as_of: dt.date, export_root: str,
                   retention_days: int = 30) -> list[str]:
    """Dump every analytics report (views and snapshots) at ``as_of`` under
    ``export_root/dt=<as_of>/<report>`` (gzip Parquet), then apply retention;
    returns the folders, whose committed run ``read_export`` reads.
    Each report is its own distributed write; nothing passes the driver."""
    import inspect

    from ..plans.registry import REPORT_FUNCTIONS
    paths = []
    for name, fn in REPORT_FUNCTIONS.items():
        kw = {"as_of": as_of} if "as_of" in inspect.signature(fn).parameters else {}
        commit_export(spark, fn(tables, **kw), export_root, name, as_of)
        paths.append(_export_folder(export_root, name, as_of))
    expire_partitions(spark, export_root, as_of, retention_days)
    return paths


def expired(partitions: list[str], as_of: dt.date, retention_days: int = 30) -> list[str]:
    """``dt=YYYY-MM-DD`` names strictly older than as_of - retention_days."""
    limit = as_of - dt.timedelta(days=retention_days)
    out = []
    for p in partitions:
        if p.startswith("dt="):
            try:
                d = dt.date.fromisoformat(p[3:])
            except ValueError:
                continue
            if d < limit:
                out.append(p)
    return out


def expire_partitions(spark: SparkSession, export_root: str, as_of: dt.date, retention_days: int = 30) -> list[str]:
    gone = expired(fsio.list_dirs(spark, export_root), as_of, retention_days)
    for n in gone:
        fsio.delete(spark, os.path.join(export_root, n))
    return gone
