"""Name -> callable(spark, sf_dir) for every implemented report/operator.

Each callable derives the logical tables from the driver tables in ``sf_dir``
(``sources.fixtures``) and returns an un-collected DataFrame.  ``as_of`` is the
fixture date; reports never read the wall clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import AS_OF, fixture_tables
from . import customers, inventory, orders, supply_chain, warehouse

Query = Callable[[SparkSession, str], DataFrame]


def _t(fn, *args, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(fixture_tables(spark, sf_dir), *args, **kw)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


REPORTS: dict[str, Query] = {
    "v1_warehouse_performance": _t(warehouse.warehouse_performance),
    "v2_inventory_summary": _t(inventory.inventory_summary),
    "v3_order_performance": _t(orders.order_performance),
    "v4_customer_insights": _t(customers.customer_insights),
    "v5_shipping_receiving_performance": _t(warehouse.shipping_receiving_performance),
    "v6_product_movement_summary": _t(inventory.product_movement_summary),
    "m1_daily_warehouse_summary": _t(warehouse.daily_warehouse_summary, AS_OF),
    "m2_monthly_inventory_summary": _t(inventory.monthly_inventory_summary, AS_OF),
    "m3_weekly_order_summary": _t(orders.weekly_order_summary, AS_OF),
    "m4_customer_lifetime_value": _t(customers.customer_lifetime_value, AS_OF),
    "m5_product_movement_30days": _t(inventory.product_movement_30days, AS_OF),
    "m6_daily_shipping_receiving": _t(warehouse.daily_shipping_receiving, AS_OF),
    "q1_warehouse_monthly_ranking": _t(orders.warehouse_monthly_ranking, AS_OF),
    "q2_inventory_forecast": _t(inventory.inventory_forecast, AS_OF),
    "q3_customer_rfm": _t(customers.customer_rfm, AS_OF),
    "q4_hourly_operations": _t(orders.hourly_operations, AS_OF),
    "q5_supply_chain": _t(supply_chain.supply_chain, AS_OF),
}


def all_queries() -> dict[str, Query]:
    from .operations import OPERATIONS
    from .primitives import PRIMITIVES
    return REPORTS | PRIMITIVES | OPERATIONS


def all_oracles() -> dict[str, str]:
    from ..checks import oracle
    out = {k: f() for k, f in oracle.REPORT_SQL.items()}
    return out | oracle.EXTRA_SQL


# report key -> function(tables[, as_of]) for library use (CLI, views)
REPORT_FUNCTIONS = {
    "v1_warehouse_performance": warehouse.warehouse_performance,
    "v2_inventory_summary": inventory.inventory_summary,
    "v3_order_performance": orders.order_performance,
    "v4_customer_insights": customers.customer_insights,
    "v5_shipping_receiving_performance": warehouse.shipping_receiving_performance,
    "v6_product_movement_summary": inventory.product_movement_summary,
    "m1_daily_warehouse_summary": warehouse.daily_warehouse_summary,
    "m2_monthly_inventory_summary": inventory.monthly_inventory_summary,
    "m3_weekly_order_summary": orders.weekly_order_summary,
    "m4_customer_lifetime_value": customers.customer_lifetime_value,
    "m5_product_movement_30days": inventory.product_movement_30days,
    "m6_daily_shipping_receiving": warehouse.daily_shipping_receiving,
    "q1_warehouse_monthly_ranking": orders.warehouse_monthly_ranking,
    "q2_inventory_forecast": inventory.inventory_forecast,
    "q3_customer_rfm": customers.customer_rfm,
    "q4_hourly_operations": orders.hourly_operations,
    "q5_supply_chain": supply_chain.supply_chain,
}


def register_views(spark: SparkSession, tables, as_of) -> list[str]:
    """Register every report as a temp view named by its key (the analytics
    layer of views), e.g. ``SELECT * FROM v1_warehouse_performance``.  The views
    read the files that ``tables`` lists; see ``ReportViews`` for current ones."""
    import inspect
    names = []
    for name, fn in REPORT_FUNCTIONS.items():
        kw = {"as_of": as_of} if "as_of" in inspect.signature(fn).parameters else {}
        fn(tables, **kw).createOrReplaceTempView(name)
        names.append(name)
    return names


class ReportViews:
    """Views recomputed on read: every query sees the tables' current files.

    ``load()`` returns the tables (``lambda: load_tables(spark, root)``); it is
    called, and the views registered anew, for each query.  Building a report
    runs no job, so this costs a listing.
    """

    def __init__(self, spark: SparkSession, load: Callable[[], dict[str, DataFrame]], as_of):
        self.spark, self.load, self.as_of = spark, load, as_of

    def sql(self, query: str) -> DataFrame:
        register_views(self.spark, self.load(), self.as_of)
        return self.spark.sql(query)
