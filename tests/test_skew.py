"""Hot keys: one key holding a third of all rows is combined map-side
(partial aggregation before the shuffle), and results stay exact."""
import contextlib
import datetime as dt
import io
from decimal import Decimal

from pyspark.sql import functions as F

from depotlens.operators.rollups import order_rollup
from depotlens.sources.tables import SCHEMAS
from depotlens.streaming import cdc

T = dt.datetime(2024, 1, 1)


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_latest_change_per_hot_key_is_partial(spark):
    n = 3000
    rows = [(i, "orders.orders", 0 if i % 3 == 0 else i, "U", float(i), T) for i in range(1, n + 1)]
    feed = spark.createDataFrame(rows, cdc.CHANGE_SCHEMA).repartition(8)
    last = cdc.latest_changes(feed)
    p = _plan(last)
    assert "partial_max_by" in p
    hot = last.where(F.col("key") == 0).first()
    assert hot.lsn == max(i for i in range(1, n + 1) if i % 3 == 0)


def test_order_rollup_combines_hot_order_map_side(spark):
    od = dt.datetime(2001, 6, 1)
    orders = spark.createDataFrame([(o, 1, 1, "completed", od, od) for o in range(1, 11)], SCHEMAS["orders"])
    items = spark.createDataFrame(
        [(f"i{i}", 1 if i % 3 == 0 else 2 + i % 9, 1, 2, 1, 1, Decimal("1.50")) for i in range(3000)],
        SCHEMAS["order_items"]).repartition(8)
    per = order_rollup(orders, items)
    p = _plan(per)
    partial = p.index("partial_sum")
    exchange = p.index("Exchange", partial) if "Exchange" in p[partial:] else -1
    assert partial >= 0 and exchange > partial   # partial aggregate sits below the shuffle
    hot = per.where(F.col("order_id") == 1).first()
    assert hot.n_child == 1000 and hot.sum_ordered == 2000 and hot.value_cents == 2 * 150 * 1000
