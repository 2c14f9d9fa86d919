"""Derive the twelve logical tables from the driver's TPC-H-like Parquet tables.

The mapping is deterministic integer arithmetic (see FIXTURES.md) and is pure
DataFrame code, so every report over these tables scales with the input: the
lineitem-derived tables are plain projections (no shuffle) except
``inventory``, which is one partial+final aggregation.  ``fixture_sql_ctes``
gives the same mapping as DuckDB SQL for the oracle queries.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import LOCATION_TYPES  # assigned by s_suppkey % 4
from .tables import conform

# Fixed values of the fixture contract: the point-in-time date of all relative
# reports (a Sunday) and the enum texts the mapping produces.
AS_OF = dt.date(2001, 7, 1)
ORDER_STATUS = {"F": "completed", "O": "pending", "P": "cancelled"}
MOVEMENT_TYPE = {"R": "in", "A": "out", "N": "transfer"}


RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


class RawTables:
    """Lazy reader of the driver tables in one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            reader = self.spark.read.schema(RAW_SCHEMAS[name])  # declared: reading a footer would be a job
            self._cache[name] = reader.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
        return self._cache[name]


def _plus_hours(ts: Column, hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours.cast("int"), ts)


def _map(col: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return out.otherwise(default) if default is not None else out


def _movement_id(li: DataFrame) -> Column:
    return F.concat_ws("-", li.l_orderkey.cast("string"), li.l_partkey.cast("string"),
                       li.l_suppkey.cast("string"), li.l_linenumber.cast("string"))


def _line_price(li: DataFrame) -> Column:
    return ((li.l_partkey % 10) + li.l_discount).cast("decimal(18,2)")


class FixtureTables(dict):
    """dict of logical table name -> DataFrame, built lazily on first access."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.raw = RawTables(spark, sf_dir)
        self.spark = spark
        self.sf_dir = sf_dir
        self.extra: list[str] = []

    def __missing__(self, name: str) -> DataFrame:
        df = conform(getattr(self, f"_{name}")(), name)
        self[name] = df
        return df

    def __contains__(self, name) -> bool:  # all logical tables are available
        return hasattr(self, f"_{name}")

    # -- dimensions ---------------------------------------------------------
    def _warehouses(self) -> DataFrame:
        n, r = self.raw["nation"], self.raw["region"]
        j = n.join(r, n.n_regionkey == r.r_regionkey)
        return j.select(n.n_nationkey.cast("long").alias("warehouse_id"), n.n_name.alias("warehouse_name"),
                        F.concat(F.lit("LOC-"), n.n_nationkey.cast("string")).alias("location_code"),
                        r.r_name.alias("region"))

    def _locations(self) -> DataFrame:
        s = self.raw["supplier"]
        k = s.s_suppkey
        ltype = F.element_at(F.array(*[F.lit(t) for t in LOCATION_TYPES]), (k % 4).cast("int") + 1)
        return s.select(k.alias("location_id"), s.s_nationkey.cast("long").alias("warehouse_id"),
                        ltype.alias("location_type"),
                        ((k * 53) % 1000).cast("decimal(18,2)").alias("utilization_rate"),
                        (F.lit(1000) + (k * 37) % 500).alias("available_capacity"),
                        ((k * 53) % 1000).alias("used_capacity"))

    def _products(self) -> DataFrame:
        p = self.raw["part"]
        return p.select(p.p_partkey.alias("product_id"), p.p_name.alias("product_name"),
                        p.p_type.alias("product_category"),
                        F.concat(p.p_brand, F.lit("-"), p.p_partkey.cast("string")).alias("sku"),
                        F.when(p.p_size % 2 == 0, "EA").otherwise("CS").alias("unit_of_measure"))

    def _customers(self) -> DataFrame:
        c, n, r = self.raw["customer"], self.raw["nation"], self.raw["region"]
        j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        return j.select(c.c_custkey.alias("customer_id"), c.c_name.alias("customer_name"),
                        c.c_mktsegment.alias("customer_type"), r.r_name.alias("region"),
                        n.n_name.alias("country"))

    def mapped(self, name: str, lineitem: DataFrame) -> DataFrame:
        """A table made of lineitem rows alone, from ``lineitem`` with further
        columns whose names start with ``_``, which are kept."""
        own = FixtureTables(self.spark, self.sf_dir)
        own.raw._cache["lineitem"] = lineitem
        own.extra = [c for c in lineitem.columns if c.startswith("_")]
        return getattr(own, f"_{name}")()

    # -- facts from lineitem --------------------------------------------------
    def _inventory(self) -> DataFrame:
        li = self.raw["lineitem"]
        g = (li.where((li.l_linenumber == 1) & (li.l_partkey % 10 != 9))
               .groupBy(li.l_partkey.alias("product_id"), li.l_suppkey.alias("location_id"))
               .agg(F.sum("l_quantity").alias("q"), F.max("l_shipdate").alias("last_updated")))
        on_hand = F.col("q").cast("long") % 20
        return g.select("product_id", "location_id", on_hand.alias("quantity_on_hand"),
                        F.call_function("div", on_hand, F.lit(2)).alias("quantity_allocated"),
                        ((F.col("product_id") % 10) + 1).cast("decimal(18,2)").alias("unit_cost"),
                        "last_updated")

    def _inventory_movements(self) -> DataFrame:
        li = self.raw["lineitem"]
        mtype = _map(li.l_returnflag, MOVEMENT_TYPE)
        return li.select(*self.extra, _movement_id(li).alias("movement_id"), li.l_partkey.alias("product_id"),
                         mtype.alias("movement_type"), li.l_shipdate.alias("movement_date"),
                         li.l_quantity.cast("long").alias("quantity_moved"),
                         _line_price(li).alias("unit_cost"),
                         F.when(li.l_returnflag == "R", None).otherwise(li.l_suppkey).alias("from_location_id"),
                         F.when(li.l_returnflag == "A", None)
                          .otherwise(li.l_suppkey + li.l_linenumber).alias("to_location_id"))

    def _order_items(self) -> DataFrame:
        li = self.raw["lineitem"]
        qty = li.l_quantity.cast("long")
        shipped = F.when(li.l_linestatus == "F", qty).otherwise(F.call_function("div", qty, F.lit(2)))
        return li.select(*self.extra, _movement_id(li).alias("order_item_id"), li.l_orderkey.alias("order_id"),
                         li.l_partkey.alias("product_id"), qty.alias("quantity_ordered"),
                         shipped.alias("quantity_shipped"), (qty - shipped).alias("quantity_backordered"),
                         _line_price(li).alias("unit_price"))

    def _shipment_items(self) -> DataFrame:
        li = self.raw["lineitem"]
        return li.where(li.l_linestatus == "F").select(*self.extra, li.l_orderkey.alias("shipment_id"),
                                                       li.l_quantity.cast("long").alias("quantity_shipped"))

    def _receipt_items(self) -> DataFrame:
        li = self.raw["lineitem"]
        return li.where(li.l_linestatus == "O").select(*self.extra, li.l_orderkey.alias("receipt_id"),
                                                       li.l_quantity.cast("long").alias("quantity_received"))

    # -- facts from orders ------------------------------------------------------
    def _orders(self) -> DataFrame:
        o = self.raw["orders"]
        k, ck = o.o_orderkey, o.o_custkey
        cust = F.when(ck % 11 == 0, None).when(ck % 7 == 3, ck % 70).otherwise(ck)
        hour0 = (k * 7) % 24
        return o.select(k.alias("order_id"), cust.alias("customer_id"),
                        F.when(k % 97 == 0, None).otherwise(k % 25).alias("warehouse_id"),
                        _map(o.o_orderstatus, ORDER_STATUS).alias("status"),
                        _plus_hours(o.o_orderdate, hour0).alias("order_date"),
                        F.when(k % 9 == 0, None)
                         .otherwise(_plus_hours(o.o_orderdate, hour0 + 1 + (k * 13) % 120)).alias("ship_date"))

    def _shipments(self) -> DataFrame:
        o = self.raw["orders"]
        k = o.o_orderkey
        return o.where(k % 3 != 0).select(
            k.alias("shipment_id"), (k % 25).alias("warehouse_id"),
            F.when(k % 5 == 0, None).otherwise(_plus_hours(o.o_orderdate, 1 + (k * 11) % 30)).alias("ship_date"),
            o.o_orderdate.alias("created_date"),
            F.when(o.o_orderstatus == "F", "shipped").otherwise("pending").alias("status"))

    def _receipts(self) -> DataFrame:
        o = self.raw["orders"]
        k = o.o_orderkey
        return o.where(k % 3 == 0).select(
            k.alias("receipt_id"), (k % 25).alias("warehouse_id"),
            F.when(k % 4 == 0, None).otherwise(_plus_hours(o.o_orderdate, k % 30)).alias("receive_date"),
            o.o_orderdate.alias("created_date"),
            F.when(o.o_orderstatus == "F", "received").otherwise("pending").alias("status"))


def fixture_tables(spark: SparkSession, sf_dir: str) -> FixtureTables:
    from ..session import ensure_utc
    ensure_utc(spark)
    return FixtureTables(spark, sf_dir)


# The same mapping as DuckDB SQL (CTE list, prefixed ``w_``), for oracle queries.
FIXTURE_CTES = {
    "w_warehouses": """SELECT CAST(n_nationkey AS BIGINT) AS warehouse_id, n_name AS warehouse_name,
        'LOC-' || CAST(n_nationkey AS VARCHAR) AS location_code, r_name AS region
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "w_locations": """SELECT s_suppkey AS location_id, CAST(s_nationkey AS BIGINT) AS warehouse_id,
        CASE s_suppkey % 4 WHEN 0 THEN 'storage' WHEN 1 THEN 'picking' WHEN 2 THEN 'receiving' ELSE 'shipping' END
          AS location_type,
        CAST((s_suppkey * 53) % 1000 AS DECIMAL(18,2)) AS utilization_rate,
        1000 + (s_suppkey * 37) % 500 AS available_capacity, (s_suppkey * 53) % 1000 AS used_capacity
        FROM supplier""",
    "w_products": """SELECT p_partkey AS product_id, p_name AS product_name, p_type AS product_category,
        p_brand || '-' || CAST(p_partkey AS VARCHAR) AS sku,
        CASE WHEN p_size % 2 = 0 THEN 'EA' ELSE 'CS' END AS unit_of_measure FROM part""",
    "w_inventory": """SELECT product_id, location_id, q AS quantity_on_hand, q // 2 AS quantity_allocated,
        CAST(product_id % 10 + 1 AS DECIMAL(18,2)) AS unit_cost, last_updated
        FROM (SELECT l_partkey AS product_id, l_suppkey AS location_id,
                     CAST(SUM(l_quantity) AS BIGINT) % 20 AS q, MAX(l_shipdate) AS last_updated
              FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 10 <> 9 GROUP BY l_partkey, l_suppkey)""",
    "w_inventory_movements": """SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS movement_id,
        l_partkey AS product_id,
        CASE l_returnflag WHEN 'R' THEN 'in' WHEN 'A' THEN 'out' WHEN 'N' THEN 'transfer' END AS movement_type,
        l_shipdate AS movement_date, CAST(l_quantity AS BIGINT) AS quantity_moved,
        CAST(l_partkey % 10 + l_discount AS DECIMAL(18,2)) AS unit_cost,
        CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_suppkey END AS from_location_id,
        CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_suppkey + l_linenumber END AS to_location_id
        FROM lineitem""",
    "w_orders": """SELECT o_orderkey AS order_id,
        CASE WHEN o_custkey % 11 = 0 THEN NULL WHEN o_custkey % 7 = 3 THEN o_custkey % 70 ELSE o_custkey END
          AS customer_id,
        CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey % 25 END AS warehouse_id,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'cancelled' END AS status,
        o_orderdate + to_hours(CAST(o_orderkey * 7 % 24 AS INT)) AS order_date,
        CASE WHEN o_orderkey % 9 = 0 THEN NULL
             ELSE o_orderdate + to_hours(CAST(o_orderkey * 7 % 24 + 1 + o_orderkey * 13 % 120 AS INT)) END AS ship_date
        FROM orders""",
    "w_order_items": """SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS order_item_id,
        l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity_ordered,
        CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) // 2 END
          AS quantity_shipped,
        CAST(l_quantity AS BIGINT) - CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT)
          ELSE CAST(l_quantity AS BIGINT) // 2 END AS quantity_backordered,
        CAST(l_partkey % 10 + l_discount AS DECIMAL(18,2)) AS unit_price
        FROM lineitem""",
    "w_customers": """SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS customer_type,
        r_name AS region, n_name AS country
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "w_shipments": """SELECT o_orderkey AS shipment_id, o_orderkey % 25 AS warehouse_id,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + to_hours(CAST(1 + o_orderkey * 11 % 30 AS INT)) END
          AS ship_date,
        o_orderdate AS created_date, CASE WHEN o_orderstatus = 'F' THEN 'shipped' ELSE 'pending' END AS status
        FROM orders WHERE o_orderkey % 3 <> 0""",
    "w_shipment_items": """SELECT l_orderkey AS shipment_id, CAST(l_quantity AS BIGINT) AS quantity_shipped
        FROM lineitem WHERE l_linestatus = 'F'""",
    "w_receipts": """SELECT o_orderkey AS receipt_id, o_orderkey % 25 AS warehouse_id,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + to_hours(CAST(o_orderkey % 30 AS INT)) END
          AS receive_date,
        o_orderdate AS created_date, CASE WHEN o_orderstatus = 'F' THEN 'received' ELSE 'pending' END AS status
        FROM orders WHERE o_orderkey % 3 = 0""",
    "w_receipt_items": """SELECT l_orderkey AS receipt_id, CAST(l_quantity AS BIGINT) AS quantity_received
        FROM lineitem WHERE l_linestatus = 'O'""",
}


def fixture_sql_ctes(names: list[str] | None = None) -> str:
    """``WITH w_a AS (...), w_b AS (...)`` prefix (without a trailing comma)."""
    keys = [f"w_{n}" for n in names] if names else list(FIXTURE_CTES)
    return "WITH " + ",\n".join(f"{k} AS ({FIXTURE_CTES[k]})" for k in keys)
