"""SparkSession construction with the settings every report relies on.

Reports are written against UTC wall-clock timestamps (``timestamp_ntz``) and
ANSI arithmetic; AQE is on so that joins against small dimensions turn into
broadcast joins only once their *runtime* size is known to be under the
threshold, and skewed shuffle partitions are split.
"""

from __future__ import annotations

import os
import tempfile
import time

from pyspark.sql import SparkSession

BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Cluster sizing, applied only where the submit configuration left a setting
# unset.  AQE coalesces shuffle partitions to ~256 MB; it cannot divide ordinary
# ones, so the number it starts from must follow the input
# (``partitions_for``); skewed partitions of joins over 512 MB (and 5x the
# median) are split; scans read 256 MB splits.
SCALE_DEFAULTS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.files.maxPartitionBytes": "256m",
    # run-time pruning of lines by their headers (sources.monthly) where no side can be broadcast; Spark estimates a
    # filtered header by the size of the whole table, so its bound for building a Bloom filter would never be met
    "spark.sql.optimizer.dynamicPartitionPruning.reuseBroadcastOnly": "false",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "100t",
}

PARTITION_BYTES = 128 << 20


def partitions_for(input_bytes: int, least: int = 200) -> int:
    """Shuffle partitions to start from for a job over ``input_bytes``: a fixed
    number would give partitions that grow with the input."""
    return max(least, -(-input_bytes // PARTITION_BYTES))


def size_for(spark: SparkSession, *paths: str) -> int:
    """Set the initial shuffle partitions from the size of ``paths`` on the
    shared file system (a listing, no job); returns the number."""
    from .operators import fsio
    n = partitions_for(sum(fsio.size(spark, p) for p in paths))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))
    return n


def apply_scale_defaults(spark: SparkSession) -> dict:
    """Set ``SCALE_DEFAULTS`` the launch configuration (submit flags, defaults
    file, builder) did not set; returns what was set."""
    launch = spark.sparkContext.getConf()
    applied = {}
    for k, v in SCALE_DEFAULTS.items():
        if not launch.contains(k):
            spark.conf.set(k, v)
            applied[k] = v
    return applied


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "depotlens", extra: dict | None = None) -> SparkSession:
    """Return a session configured for the reports.

    ``master`` and ``shuffle_partitions`` are only for local runs; on a cluster
    leave them ``None`` and let the submit configuration decide.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if master is None or not master.startswith("local"):
        apply_scale_defaults(spark)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is.  Only when it is unset (local tests) a scratch folder is created.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="depotlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


#: setting -> (Spark's default, for lines that are pruned by few of their headers).  By default Spark filters no scan
#: below 10 GB, and takes a filtered header for as large as its table.
PRUNING = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": ("10GB", "64m"),
           "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": ("10MB", "100t")}


def prune_at_run_time(spark: SparkSession) -> None:
    """Let Spark drop lines by a Bloom filter of their headers' ids before they
    are shuffled; what the user set stays."""
    for key, (default, value) in PRUNING.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, value)


#: Bytes that a task reads where it sorts what it reads.
SORTED_SPLIT = ("spark.sql.files.maxPartitionBytes", "32m")


def split_to_sort(spark: SparkSession) -> None:
    """Let a task read a quarter of Spark's default, for plans that sort rows
    before they shuffle them (the latest change of a key): what a task of the
    default size made of its rows would not fit its memory.  What the user set
    stays."""
    key, size = SORTED_SPLIT
    if not spark.sparkContext.getConf().contains(key) and spark.conf.get(key) in ("134217728b", SCALE_DEFAULTS[key]):
        spark.conf.set(key, size)


def checkpoint_root(spark: SparkSession, *parts: str) -> str:
    """A sub-folder of the shared checkpoint folder, for written tables."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return os.path.join(base, *parts) if parts else base


#: Folders below the checkpoint folder whose tables serve one result only.
WRITTEN = ("llm", "positions", "feed", "bitmaps", "refreshed", "exports", "bucketed", "monthly", "delta_v3")


def expire_written(spark: SparkSession, hours: float) -> list[str]:
    """Remove tables that results wrote on their way (stages, rounds of an
    iteration, sorted copies) and that nothing has changed for ``hours``: longer
    than any result takes to be stored.  Snapshots, replicas and states stay."""
    from .operators import fsio
    gone = []
    for part in WRITTEN:
        gone += [f"{part}/{n}" for n in fsio.expire(spark, checkpoint_root(spark, part), time.time() - hours * 3600)]
    return gone


def ensure_utc(spark: SparkSession) -> None:
    """Reports are defined on UTC wall-clock ``timestamp_ntz`` values; Spark
    routes some NTZ arithmetic (date_trunc, timestampdiff) through the session
    zone, so a non-UTC session could shift results across DST changes."""
    if spark.conf.get("spark.sql.session.timeZone", "UTC") not in UTC_NAMES:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


UTC_NAMES = {"UTC", "Etc/UTC", "Etc/UCT", "UCT", "GMT", "Etc/GMT", "Z", "Zulu", "+00:00"}
