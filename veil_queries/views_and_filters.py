"""Sources, views and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortveil.operators import views as V
from cohortveil.operators.predicates import selected_values
from cohortveil.operators.cells import long_values
from cohortveil.sources.tables import json_rows, load_tables
from cohortveil.specs import Filter, check_filters
from cohortveil.studies import shop
from cohortveil.study import PERSON

from .registry import query
from .sqltext import CLICKS, CUSTOMER_SALES, SALES


@query("S1_load_tables", """
SELECT 'customer' AS name, COUNT(*) AS n FROM customer UNION ALL SELECT 'orders', COUNT(*) FROM orders
UNION ALL SELECT 'events', COUNT(*) FROM events""")
def s1(spark, d):
    tables = load_tables(spark, d, ["customer", "orders", "events"])
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.union(part)
    return out


@query("S4_registered_views", f"""WITH {SALES}, {CUSTOMER_SALES}
SELECT s.r_name, s.orders, c.persons FROM
 (SELECT r_name, COUNT(*) AS orders FROM sales GROUP BY r_name) s
 JOIN (SELECT r_name, COUNT(*) AS persons FROM customer_sales GROUP BY r_name) c ON s.r_name = c.r_name""")
def s4(spark, d):
    shop.workspace(spark, d).register("shop_")
    return spark.sql("""
        SELECT s.r_name, s.orders, c.persons FROM
          (SELECT r_name, COUNT(*) AS orders FROM shop_sales GROUP BY r_name) s
          JOIN (SELECT r_name, COUNT(*) AS persons FROM shop_customer_sales GROUP BY r_name) c
          ON s.r_name = c.r_name""")


@query("S5_json_rows", f"""WITH {SALES}
SELECT '{{"r_name":"' || r_name || '","n":' || CAST(COUNT(*) AS VARCHAR) || '}}' AS row
FROM sales GROUP BY r_name""")
def s5(spark, d):
    ws = shop.workspace(spark, d)
    return json_rows(ws.public("sales").groupBy("r_name").agg(F.count(F.lit(1)).alias("n")))


@query("V1_public_view", f"""WITH {SALES}
SELECT r_name, n_name, c_mktsegment, o_orderpriority, o_orderstatus, order_year, order_month, is_urgent,
       CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM sales""")
def v1(spark, d):
    df = shop.workspace(spark, d).public("sales")
    return df.withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query("V2_unit_view", f"""WITH {SALES}
SELECT person AS _person, balance, CAST(c_acctbal AS DOUBLE) AS c_acctbal, r_name, c_mktsegment,
       CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM sales""")
def v2(spark, d):
    return shop.workspace(spark, d).unit("sales").select(
        PERSON, "balance", F.col("c_acctbal").cast("double").alias("c_acctbal"), "r_name",
        "c_mktsegment", F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query("V3_person_rollup", f"""WITH {CUSTOMER_SALES}
SELECT person AS _person, r_name, n_name, c_mktsegment, CAST(total_price AS DOUBLE) AS total_price,
       CAST(open_price AS DOUBLE) AS open_price, open_orders, urgent_orders FROM customer_sales""")
def v3(spark, d):
    df = shop.workspace(spark, d).unit("customer_sales").drop("c_acctbal")
    return (df.withColumn("total_price", F.col("total_price").cast("double"))
            .withColumn("open_price", F.col("open_price").cast("double")))


@query("V4_sum_if", f"""WITH {CUSTOMER_SALES}
SELECT c_mktsegment, CAST(SUM(open_price) AS DOUBLE) AS open_price FROM customer_sales GROUP BY c_mktsegment""")
def v4(spark, d):
    df = shop.workspace(spark, d).public("customer_sales")
    return df.groupBy("c_mktsegment").agg(F.sum("open_price").cast("double").alias("open_price"))


@query("V5_count_if", f"""WITH {CUSTOMER_SALES}
SELECT c_mktsegment, urgent_orders, COUNT(*) AS persons FROM customer_sales GROUP BY ALL""")
def v5(spark, d):
    df = shop.workspace(spark, d).public("customer_sales")
    return df.groupBy("c_mktsegment", "urgent_orders").agg(F.count(F.lit(1)).alias("persons"))


@query("V6_inner_join", """
SELECT c.c_mktsegment, l.l_returnflag, COUNT(*) AS n FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY ALL""")
def v6(spark, d):
    df = shop.workspace(spark, d).public("lines")
    return df.groupBy("c_mktsegment", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("V7_left_join", """
SELECT c.c_custkey AS person, CAST(SUM(CASE WHEN o.o_orderkey IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS n_orders,
       CAST(SUM(CASE WHEN o.o_orderstatus = 'P' THEN CAST(o.o_totalprice AS DECIMAL(12,2)) ELSE 0 END) AS DOUBLE) AS pending
FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON c.c_custkey = o.o_custkey GROUP BY 1""")
def v7(spark, d):
    from dataclasses import replace

    from cohortveil.study import CountIf, SumIf

    base = shop.study()
    view = replace(base.view("customer_sales"), columns={
        "c_mktsegment": "customer.c_mktsegment", "n_orders": CountIf("orders.o_orderstatus", "P"),
        "pending": SumIf("orders.o_totalprice", "orders.o_orderstatus", ("P",))},
        dims={"c_mktsegment": "cat"}, measures=("pending", "n_orders"), responses={})
    declared = replace(base, views={**base.views, "customer_sales": view}, quantities={})
    ws = shop.workspace(spark, d, declared, orders=lambda t: t.where(F.col("o_orderstatus") == "P"))
    return ws.unit("customer_sales").select(
        F.col(PERSON).alias("person"), "n_orders", F.col("pending").cast("double").alias("pending"))


@query("V8_dense_panel", f"""WITH {CLICKS}, grid AS (
  SELECT p.person, CAST(g.day AS INTEGER) AS day FROM (SELECT DISTINCT person FROM clicks) p
  CROSS JOIN (SELECT unnest(range(0, 30)) AS day) g),
totals AS (SELECT person, day, COUNT(*) AS k, SUM(value) AS total FROM clicks GROUP BY person, day)
SELECT g.person AS user_id, g.day, coalesce(t.k, 0) AS rows, CAST(coalesce(t.total, 0) AS DOUBLE) AS total
FROM grid g LEFT JOIN totals t ON g.person = t.person AND g.day = t.day""")
def v8(spark, d):
    ws = shop.workspace(spark, d)
    events = ws.tables["events"]
    panel = V.dense_panel(events, events, "user_id", "day", 0, 29, {"total": "value"})
    return panel.withColumn("total", F.col("total").cast("double"))


CUTS, CUT_LABELS = (50000, 150000, 300000), ("low", "mid", "high", "top")


@query("V9_band_by_cuts", """
SELECT band, COUNT(*) AS n FROM (SELECT CASE WHEN o_totalprice IS NULL THEN NULL
  WHEN o_totalprice <= 50000 THEN 'low' WHEN o_totalprice <= 150000 THEN 'mid'
  WHEN o_totalprice <= 300000 THEN 'high' ELSE 'top' END AS band FROM orders) GROUP BY band""")
def v9(spark, d):
    orders = shop.workspace(spark, d).tables["orders"]
    band = V.band_by_cuts(F.col("o_totalprice"), CUTS, CUT_LABELS)
    return orders.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("V10_band_by_edges", """
SELECT band, COUNT(*) AS n FROM (SELECT CASE WHEN b BETWEEN -1000 AND -1 THEN 'overdrawn'
  WHEN b BETWEEN 0 AND 1999 THEN '0-2k' WHEN b BETWEEN 2000 AND 3999 THEN '2k-4k'
  WHEN b BETWEEN 4000 AND 5999 THEN '4k-6k' WHEN b BETWEEN 6000 AND 7999 THEN '6k-8k'
  WHEN b BETWEEN 8000 AND 10000 THEN '8k-10k' END AS band
  FROM (SELECT floor(c_acctbal) AS b FROM customer)) GROUP BY band""")
def v10(spark, d):
    customer = shop.workspace(spark, d).tables["customer"]
    band = V.band_by_edges(F.col("balance"), shop.BALANCE_EDGES, shop.BALANCE_BANDS, strict=True)
    return customer.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def _filtered(name, sql_where, filters):
    @query(name, f"""WITH {SALES}
SELECT o_orderstatus, COUNT(*) AS n, COUNT(DISTINCT person) AS n_persons FROM sales
WHERE {sql_where} GROUP BY o_orderstatus""")
    def run(spark, d):
        ws = shop.workspace(spark, d)
        check_filters(ws.study, ws.study.view("sales"), filters)
        pp = ws.per_person("sales", ("o_orderstatus",), tuple(filters))
        return pp.groupBy("o_orderstatus").agg(F.sum("_n").alias("n"),
                                               F.count(F.lit(1)).alias("n_persons"))
    return run


_filtered("F1_equality", "r_name = 'ASIA' AND o_orderpriority != '5-LOW' AND is_urgent = FALSE",
          [Filter("r_name", "==", "ASIA"), Filter("o_orderpriority", "!=", "5-LOW"),
           Filter("is_urgent", "==", False)])
_filtered("F2_comparison", "order_year >= 1996 AND order_year < 1999 AND order_month > 2 AND order_month <= 11",
          [Filter("order_year", ">=", 1996), Filter("order_year", "<", 1999),
           Filter("order_month", ">", 2), Filter("order_month", "<=", 11)])
_filtered("F3_membership", "c_mktsegment IN ('BUILDING','MACHINERY') AND order_month IN (1, 6, 12)",
          [Filter("c_mktsegment", "in", ["BUILDING", "MACHINERY"]), Filter("order_month", "in", [1, 6, 12])])
_filtered("F4_conjunction", "TRUE", [])
_filtered("F5_band_range", "balance >= 2000 AND balance <= 7999",
          [Filter("balance", ">=", 2000), Filter("balance", "<=", 7999)])


@query("F6_not_null_guard", f"""WITH {SALES}
SELECT n_name, COUNT(*) AS n, COUNT(DISTINCT person) AS n_persons FROM
 (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS v FROM sales)
WHERE v IS NOT NULL GROUP BY n_name""")
def f6(spark, d):
    ws = shop.workspace(spark, d, orders=lambda t: t.withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice"))))
    pp = ws.per_person("sales", ("n_name",), (), ("o_totalprice",))
    return pp.groupBy("n_name").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_persons"))


@query("F10_value_sets", f"""WITH {SALES}, vals AS (
  SELECT 'c_mktsegment' AS dim, c_mktsegment AS value FROM sales GROUP BY ALL
  UNION ALL SELECT 'order_year', CAST(order_year AS VARCHAR) FROM sales GROUP BY ALL)
SELECT 'a' AS cohort_id, dim, value, value <> 'BUILDING' AS chosen FROM vals WHERE dim = 'c_mktsegment'
UNION ALL SELECT 'a', dim, value, CAST(value AS INTEGER) >= 1996 AND CAST(value AS INTEGER) < 2000 FROM vals WHERE dim = 'order_year'
UNION ALL SELECT 'b', dim, value, value IN ('BUILDING', 'FURNITURE') FROM vals WHERE dim = 'c_mktsegment'""")
def f10(spark, d):
    ws = shop.workspace(spark, d)
    kinds = {"c_mktsegment": "cat", "order_year": "int"}
    values = long_values(ws.unit("sales").select(*kinds).distinct(), "sales", kinds).distinct()
    cohorts = spark.createDataFrame(
        [("a", "sales", [("c_mktsegment", "!=", ["BUILDING"]), ("order_year", ">=", ["1996"]),
                         ("order_year", "<", ["2000"])]),
         ("b", "sales", [("c_mktsegment", "in", ["FURNITURE", "BUILDING"])])],
        "cohort_id string, view string, predicates array<struct<column:string,op:string,values:array<string>>>")
    return selected_values(cohorts, values).drop("view")


def _dictionary_sql() -> str:
    stored = {"order_year": "o_orderdate", "order_month": "o_orderdate", "is_urgent": "o_orderpriority",
              "balance": "c_acctbal", "ship_year": "l_shipdate", "hour_band": "ts", "day": "ts"}
    study, parts = shop.study(), []
    for table, columns in study.tables.items():
        for c, role in columns.items():
            domain = ";".join(study.domain(c) or ())
            parts.append(f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", '{role}' AS role, "
                         f"'{study.descriptions.get(c, '')}' AS description, '{domain}' AS domain, "
                         f"COUNT({stored.get(c, c)}) AS filled FROM {table}")
    return " UNION ALL ".join(parts)


@query("V11_data_dictionary", _dictionary_sql())
def v11(spark, d):
    """Declared columns with how many values the tables really hold."""
    ws = shop.workspace(spark, d)
    counts = None
    for name in sorted(ws.study.tables):
        df, columns = ws.tables[name], sorted(ws.study.tables[name])
        row = df.agg(*(F.count(c).alias(c) for c in columns))
        part = row.select(F.lit(name).alias("table"), F.inline(F.array(*(
            F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in columns))))
        counts = part if counts is None else counts.union(part)
    words = V.data_dictionary(spark, ws.study).join(counts, ["table", "column"])
    return words.withColumn("domain", F.coalesce(F.array_join("domain", ";"), F.lit("")))

