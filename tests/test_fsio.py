"""Commit-point IO on the shared file system."""
import os

from depotlens.operators import fsio


def test_atomic_overwrite_and_listing(spark, scratch):
    p = os.path.join(scratch, "sub", "_manifest.json")
    assert fsio.read_text(spark, p) is None
    fsio.write_text_atomic(spark, p, '{"a": 1}')
    fsio.write_text_atomic(spark, p, '{"a": 2}')
    assert fsio.read_text(spark, p) == '{"a": 2}'
    assert [f for f in os.listdir(os.path.dirname(p)) if f.endswith(".tmp")] == []
    fsio.mkdirs(spark, os.path.join(scratch, "dt=2001-07-01"))
    assert "dt=2001-07-01" in fsio.list_dirs(spark, scratch)
    fsio.delete(spark, os.path.join(scratch, "dt=2001-07-01"))
    assert not fsio.exists(spark, os.path.join(scratch, "dt=2001-07-01"))
