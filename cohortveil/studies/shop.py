"""Example study over an order-and-event schema: persons are customers and users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.views import LazyTables, Workspace
from ..sources.tables import load_table
from ..study import BandEdges, CountIf, Join, Study, SumIf, View

# Declared category lists of the study.
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STATUSES = ("F", "O", "P")
BALANCE_EDGES = BandEdges(lower=(-1000, 0, 2000, 4000, 6000, 8000),
                          upper=(-1, 1999, 3999, 5999, 7999, 10000))
BALANCE_BANDS = ("overdrawn", "0-2k", "2k-4k", "4k-6k", "6k-8k", "8k-10k")

MONEY = "decimal(12,2)"


def study(**domains: tuple) -> Study:
    geo = (Join("customer", "orders.o_custkey", "c_custkey"),
           Join("nation", "customer.c_nationkey", "n_nationkey"),
           Join("region", "nation.n_regionkey", "r_regionkey"))
    sales = View(
        base="orders", person="orders.o_custkey", joins=geo,
        columns={"r_name": "region.r_name", "n_name": "nation.n_name",
                 "c_mktsegment": "customer.c_mktsegment",
                 "o_orderpriority": "orders.o_orderpriority",
                 "o_orderstatus": "orders.o_orderstatus",
                 "order_year": "orders.order_year", "order_month": "orders.order_month",
                 "is_urgent": "orders.is_urgent", "o_totalprice": "orders.o_totalprice"},
        unit_columns={"balance": "customer.balance", "c_acctbal": "customer.c_acctbal"},
        dims={"r_name": "cat", "n_name": "cat", "c_mktsegment": "cat", "o_orderpriority": "cat",
              "o_orderstatus": "cat", "order_year": "int", "order_month": "int",
              "is_urgent": "bool"},
        measures=("o_totalprice",), internal_filters={"balance": "int"},
        internal_measures=("c_acctbal",),
        responses={"o_totalprice": ("gaussian",), "is_urgent": ("binomial",)},
        time_dims=("order_year", "order_month"), population="customers")
    customer_sales = View(
        base="customer", person="customer.c_custkey",
        joins=(Join("nation", "customer.c_nationkey", "n_nationkey"),
               Join("region", "nation.n_regionkey", "r_regionkey"),
               Join("orders", "customer.c_custkey", "o_custkey", "left")),
        columns={"r_name": "region.r_name", "n_name": "nation.n_name",
                 "c_mktsegment": "customer.c_mktsegment",
                 "total_price": SumIf("orders.o_totalprice", "orders.o_orderstatus", STATUSES),
                 "open_price": SumIf("orders.o_totalprice", "orders.o_orderstatus", ("O", "P")),
                 "open_orders": CountIf("orders.o_orderstatus", "O"),
                 "urgent_orders": CountIf("orders.o_orderpriority", "1-URGENT")},
        unit_columns={"c_acctbal": "customer.c_acctbal"},
        dims={"r_name": "cat", "n_name": "cat", "c_mktsegment": "cat"},
        measures=("total_price", "open_price", "open_orders", "urgent_orders"),
        internal_measures=("c_acctbal",),
        responses={"open_orders": ("poisson", "gaussian"), "urgent_orders": ("poisson",),
                   "total_price": ("gaussian",)}, population="customers")
    lines = View(
        base="lineitem", person="orders.o_custkey",
        joins=(Join("orders", "lineitem.l_orderkey", "o_orderkey"),
               Join("customer", "orders.o_custkey", "c_custkey")),
        columns={"l_returnflag": "lineitem.l_returnflag", "l_linestatus": "lineitem.l_linestatus",
                 "c_mktsegment": "customer.c_mktsegment", "ship_year": "lineitem.ship_year",
                 "l_quantity": "lineitem.l_quantity", "l_extendedprice": "lineitem.l_extendedprice",
                 "l_discount": "lineitem.l_discount"},
        dims={"l_returnflag": "cat", "l_linestatus": "cat", "c_mktsegment": "cat", "ship_year": "int"},
        measures=("l_quantity", "l_extendedprice", "l_discount"),
        responses={"l_quantity": ("gaussian",), "l_extendedprice": ("gaussian",)},
        population="customers")
    clicks = View(
        base="events", person="events.user_id",
        columns={"event_type": "events.event_type", "hour_band": "events.hour_band",
                 "day": "events.day", "value": "events.value"},
        dims={"event_type": "cat", "hour_band": "int", "day": "int"}, measures=("value",),
        responses={"value": ("gaussian",)}, time_dims=("day",), population="users")
    return Study(
        name="shop",
        tables={
            "orders": {"o_orderkey": "meta", "o_custkey": "DI", "o_orderstatus": "QI",
                       "o_totalprice": "S", "o_orderpriority": "QI", "order_year": "QI",
                       "order_month": "QI", "is_urgent": "QI"},
            "customer": {"c_custkey": "DI", "c_name": "DI", "c_nationkey": "R", "c_acctbal": "S",
                         "balance": "S", "c_mktsegment": "QI"},
            "nation": {"n_nationkey": "R", "n_name": "QI", "n_regionkey": "R"},
            "region": {"r_regionkey": "R", "r_name": "QI"},
            "lineitem": {"l_orderkey": "meta", "l_quantity": "S", "l_extendedprice": "S",
                         "l_discount": "S", "l_returnflag": "QI", "l_linestatus": "QI",
                         "ship_year": "QI"},
            "events": {"event_id": "meta", "user_id": "DI", "event_type": "QI", "value": "S",
                       "hour_band": "QI", "day": "QI", "props": "S"}},
        views={"sales": sales, "customer_sales": customer_sales, "lines": lines, "clicks": clicks},
        domains={"r_name": REGIONS, "c_mktsegment": SEGMENTS, "o_orderpriority": PRIORITIES,
                 "o_orderstatus": STATUSES, **domains},
        descriptions={"o_custkey": "the customer who ordered", "o_totalprice": "order value",
                      "c_mktsegment": "market segment"},
        derived_roles={"total_price": "S", "open_price": "S", "open_orders": "S",
                       "urgent_orders": "S"},
        quantities={"order_value": {"sales": "o_totalprice", "customer_sales": "total_price"}},
        bands={"balance": BALANCE_EDGES},
        synonyms={"region": "r_name", "nation": "n_name", "market segment": "c_mktsegment",
                  "segment": "c_mktsegment", "order priority": "o_orderpriority",
                  "priority": "o_orderpriority", "order status": "o_orderstatus",
                  "status": "o_orderstatus", "order year": "order_year", "year": "order_year",
                  "month": "order_month", "event type": "event_type", "day": "day"},
        free_text=frozenset({"free_text", "props"}))


def money(c: str):
    return F.col(c).cast(MONEY).alias(c)


def derive(name: str, table: DataFrame) -> DataFrame:
    """Coarsen timestamps and money into the declared columns."""
    if name == "orders":
        return table.select(
            "o_orderkey", "o_custkey", "o_orderstatus", money("o_totalprice"), "o_orderpriority",
            F.year("o_orderdate").alias("order_year"), F.month("o_orderdate").alias("order_month"),
            (F.col("o_orderpriority") == "1-URGENT").alias("is_urgent"))
    if name == "customer":
        return table.select(
            "c_custkey", "c_name", "c_nationkey", money("c_acctbal"),
            F.floor("c_acctbal").cast("int").alias("balance"), "c_mktsegment")
    if name == "lineitem":
        return table.select(
            "l_orderkey", money("l_quantity"), money("l_extendedprice"), money("l_discount"),
            "l_returnflag", "l_linestatus", F.year("l_shipdate").alias("ship_year"))
    if name == "events":
        return table.select(
            "event_id", "user_id", "event_type", money("value"),
            F.floor(F.hour("ts") / 6).cast("int").alias("hour_band"),
            F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day"), "props")
    return table


# The stored column types, so that no file is opened to infer them.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
TABLES = ("orders", "customer", "nation", "region", "lineitem", "events")


def workspace(spark: SparkSession, folder: str, declared: Study | None = None, **changed) -> Workspace:
    """The study over parquet files of a folder; ``changed`` replaces tables."""
    declared = declared or study()

    def load(name):
        df = derive(name, load_table(spark, f"{folder}/{name}.parquet", schema=SCHEMAS[name]))
        return changed[name](df) if name in changed else df

    return Workspace(declared, LazyTables(declared, load), checked=True)
