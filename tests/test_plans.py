"""Physical-plan properties: pushed date filters, no cross products, no Python."""
import os
import re

import pytest

import __spark_entry__ as E
from conftest import ROOT, SF_SMALL
from depotlens.plans import orders, supply_chain, warehouse
from depotlens.sources.fixtures import AS_OF
from depotlens.sources.tables import load_tables, write_tables


def plan(df) -> str:
    """The text ``df.explain("formatted")`` prints (untruncated operator details)."""
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def stored(spark, small_tables, tmp_path_factory):
    """The logical tables written as Parquet folders and read back with schemas."""
    root = str(tmp_path_factory.mktemp("tables"))
    write_tables(small_tables, root, partitions=4)
    return load_tables(spark, root)


def test_layout_round_trip(stored, small_tables):
    assert stored["orders"].count() == small_tables["orders"].count()
    files = stored["orders"].inputFiles()
    assert len(files) >= 2   # range-partitioned by order_date


def test_bucket_filter_reaches_scan(stored):
    p = plan(orders.weekly_order_summary(stored, AS_OF))
    pushed = [ln for ln in p.splitlines() if ln.startswith("PushedFilters") and "order_date" in ln]
    assert any("GreaterThanOrEqual(order_date,2001-06-25T00:00)" in ln and
               "LessThan(order_date,2001-07-02T00:00)" in ln for ln in pushed), pushed


def test_column_pruning(stored):
    p = plan(warehouse.warehouse_performance(stored))
    schemas = [ln for ln in p.splitlines() if ln.startswith("ReadSchema") and "location_type" in ln]
    # locations: only the 6 used columns are read; warehouses: id, name, code (no region)
    assert schemas and all("warehouse_name" not in ln for ln in schemas)
    assert not any("region" in ln for ln in p.splitlines() if ln.startswith("ReadSchema"))


def test_q5_has_no_cross_product(stored):
    p = plan(supply_chain.supply_chain(stored, AS_OF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("key", sorted(E.queries()))
def test_no_python_and_no_cross_join(spark, key):
    if key == "export_snapshot":
        pytest.skip("writes files; its read-back plan is a plain scan")
    p = plan(E.queries()[key](spark, SF_SMALL))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in p, (key, bad)


def test_no_wall_clock_in_library():
    pat = re.compile(r"current_date|current_timestamp|\bnow\(\)|date\.today", re.I)
    hits = []
    for dirpath, _, files in os.walk(os.path.join(ROOT, "depotlens")):
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(dirpath, f)).read()
                # snapshot version ids are the only clock use (not report input)
                text = text.replace("dt.datetime.now(dt.timezone.utc)", "")
                if pat.search(text):
                    hits.append(f)
    assert not hits, hits


@pytest.mark.parametrize("key", ["v3_order_performance", "m3_weekly_order_summary", "m6_daily_shipping_receiving",
                                 "q2_inventory_forecast", "q5_supply_chain", "v6_product_movement_summary"])
def test_stored_tables_give_same_results(stored, small_tables, key):
    import inspect

    from depotlens.checks.compare import rows_multiset
    from depotlens.plans.registry import REPORT_FUNCTIONS
    from depotlens.sources.fixtures import AS_OF
    fn = REPORT_FUNCTIONS[key]
    kw = {"as_of": AS_OF} if "as_of" in inspect.signature(fn).parameters else {}
    a, b = fn(stored, **kw), fn(small_tables, **kw)
    assert rows_multiset(a.columns, a.collect()) == rows_multiset(b.columns, b.collect())
