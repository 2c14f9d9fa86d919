"""Small-file IO on the cluster's shared file system (any Hadoop FS: HDFS,
object stores, file://), through the session's Hadoop configuration.

Used for the commit points of snapshots and CDC state: a manifest / pointer
is written to a temporary name and renamed over the old one
(``FileContext.rename(.., OVERWRITE)``, atomic on HDFS and local FS).
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _jvm(spark: SparkSession):
    return spark.sparkContext._jvm


def _conf(spark: SparkSession):
    return spark.sparkContext._jsc.hadoopConfiguration()


def _path(spark: SparkSession, path: str):
    return _jvm(spark).org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    p = _path(spark, path)
    return p.getFileSystem(_conf(spark)), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def mkdirs(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]


def size(spark: SparkSession, path: str) -> int:
    """Bytes below ``path``."""
    fs, p = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def files(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number of the files below ``path``, and their bytes."""
    fs, p = _fs(spark, path)
    s = fs.getContentSummary(p)
    return int(s.getFileCount()), int(s.getLength())


def expire(spark: SparkSession, root: str, before: float) -> list[str]:
    """Delete the folders directly below ``root`` that were last changed before
    the POSIX time ``before``; returns their names."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    old = [st.getPath() for st in fs.listStatus(p) if st.isDirectory() and st.getModificationTime() < before * 1000]
    for path in old:
        fs.delete(path, True)
    return sorted(path.getName() for path in old)


def delete(spark: SparkSession, path: str, recursive: bool = True) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, recursive)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    jvm = _jvm(spark)
    stream = fs.open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        lines = []
        line = reader.readLine()
        while line is not None:
            lines.append(line)
            line = reader.readLine()
        return "\n".join(lines)
    finally:
        stream.close()


def write_text_atomic(spark: SparkSession, path: str, text: str) -> None:
    """Write ``text`` to ``path`` so readers see the old or the new content."""
    jvm = _jvm(spark)
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    tmp = jvm.org.apache.hadoop.fs.Path(p.getParent(), f"._{p.getName()}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    fc = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), _conf(spark))
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    opts = spark.sparkContext._gateway.new_array(rename, 1)
    opts[0] = rename.OVERWRITE
    fc.rename(tmp, p, opts)
