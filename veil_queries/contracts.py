"""Declaration-driven checks run over the tables they protect."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortveil.operators import cells as C
from cohortveil.operators import gateway as G
from cohortveil.operators.declared import violations
from cohortveil.operators.release_audit import egress
from cohortveil.operators.rules import denial_reasons
from cohortveil.plans.staged import cohort_of
from cohortveil.session import cut
from cohortveil.sources.tables import load_tables, save_tables, tables_missing
from cohortveil.specs import Filter, Measure, QuerySpec, check_filters
from cohortveil.studies import shop
from cohortveil.study import StudyError

from .registry import query
from .sqltext import SALES
from .text_and_audit import PLAN, read


def folder(spark) -> str:
    """A fresh folder beside the cluster's checkpoints."""
    cut(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/out-{uuid.uuid4().hex}"


@query("S2_tables_present", """SELECT 'orders' AS name, TRUE AS present, COUNT(*) AS n FROM orders
UNION ALL SELECT 'events', TRUE, COUNT(*) FROM events UNION ALL SELECT 'refunds', FALSE, 0 FROM region WHERE r_regionkey = 0""")
def s2(spark, d):
    out, names = None, ["orders", "events", "refunds"]
    missing = set(tables_missing(spark, d, names))
    for name in names:
        rows = (spark.range(1).select(F.lit(0).cast("bigint").alias("n")) if name in missing
                else read(spark, d, name).agg(F.count(F.lit(1)).alias("n")))
        part = rows.select(F.lit(name).alias("name"), F.lit(name not in missing).alias("present"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("S3_saved_tables", """SELECT o_orderpriority, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total
FROM orders GROUP BY o_orderpriority""")
def s3(spark, d):
    """Written and read back as CSV with the declared schema."""
    path, ws = folder(spark), shop.workspace(spark, d)
    save_tables({"orders": ws.tables["orders"]}, path, "csv")
    back = load_tables(spark, path, ["orders"], "csv", {"orders": ws.tables["orders"].schema})["orders"]
    return back.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").cast("double").alias("total"))


@query("V12_columns_by_role", """SELECT 'identifier' AS role, 'o_custkey' AS column, COUNT(o_custkey) AS filled FROM orders
UNION ALL SELECT 'identifier', 'c_custkey', COUNT(c_custkey) FROM customer UNION ALL SELECT 'identifier', 'c_name', COUNT(c_name) FROM customer
UNION ALL SELECT 'identifier', 'user_id', COUNT(user_id) FROM events UNION ALL SELECT 'sensitive', 'o_totalprice', COUNT(o_totalprice) FROM orders
UNION ALL SELECT 'sensitive', 'c_acctbal', COUNT(c_acctbal) FROM customer UNION ALL SELECT 'sensitive', 'balance', COUNT(c_acctbal) FROM customer
UNION ALL SELECT 'sensitive', 'l_quantity', COUNT(l_quantity) FROM lineitem UNION ALL SELECT 'sensitive', 'l_extendedprice', COUNT(l_extendedprice) FROM lineitem
UNION ALL SELECT 'sensitive', 'l_discount', COUNT(l_discount) FROM lineitem UNION ALL SELECT 'sensitive', 'value', COUNT(value) FROM events
UNION ALL SELECT 'sensitive', 'props', COUNT(props) FROM events""")
def v12(spark, d):
    """Identifier and sensitive columns with how many cells they fill."""
    ws, out = shop.workspace(spark, d), None
    for role, columns in (("identifier", ws.study.having_role("DI")), ("sensitive", ws.study.having_role("S"))):
        for table, declared in sorted(ws.study.tables.items()):
            mine = sorted(columns & set(declared))
            if mine:
                one = ws.tables[table].agg(*(F.count(c).alias(c) for c in mine))
                part = one.select(F.lit(role).alias("role"), F.inline(F.array(*(
                    F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in mine))))
                out = part if out is None else out.unionByName(part)
    return out


F9_FILTERS = (Filter("r_name", "==", "ASIA"), Filter("r_name", "<", "ASIA"), Filter("order_year", "==", 1996),
              Filter("order_year", "==", "1996"), Filter("balance", ">=", 2000), Filter("balance", ">=", 2001),
              Filter("o_totalprice", "==", 5), Filter("is_urgent", "==", True))


@query("F9_admitted_filters", f"""WITH {SALES} SELECT 0 AS position, COUNT(DISTINCT person) AS n_persons FROM sales WHERE r_name = 'ASIA'
UNION ALL SELECT 2, COUNT(DISTINCT person) FROM sales WHERE order_year = 1996 UNION ALL SELECT 4, COUNT(DISTINCT person) FROM sales WHERE balance >= 2000
UNION ALL SELECT 7, COUNT(DISTINCT person) FROM sales WHERE is_urgent""")
def f9(spark, d):
    """Of eight proposed filters the admissible ones, with the cohorts they select."""
    ws, out = shop.workspace(spark, d), None
    for i, f in enumerate(F9_FILTERS):
        try:
            check_filters(ws.study, ws.study.view("sales"), [f])
        except StudyError:
            continue
        part = C.cohort_size(ws, "sales", (f,)).select(F.lit(i).alias("position"), "n_persons")
        out = part if out is None else out.unionByName(part)
    return out


def _withheld(ws, outputs, reasons):
    out = None
    for name, df in outputs.items():
        found = reasons(df.columns, ws.study)
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("output"), F.lit(",".join(sorted(found))).alias("reasons"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("R6_denied_outputs", f"""WITH {SALES} SELECT 'orders' AS output, 'identifier_egress,raw_sensitive' AS reasons, COUNT(*) AS n_rows FROM orders
UNION ALL SELECT 'values', 'raw_sensitive', COUNT(*) FROM orders UNION ALL SELECT 'props', 'free_text_egress,raw_sensitive', COUNT(*) FROM events
UNION ALL SELECT 'cells', '', COUNT(DISTINCT r_name) FROM sales""")
def r6(spark, d):
    """Proposed outputs with the reasons to deny them as a whole (identifiers, raw values, free text)."""
    ws = shop.workspace(spark, d)
    return _withheld(ws, {
        "orders": ws.tables["orders"], "values": ws.public("sales").select("r_name", "o_totalprice"),
        "props": ws.tables["events"].select("event_type", "props"),
        "cells": C.cells(ws, QuerySpec("sales", Measure("mean", "o_totalprice"), ("r_name",))).drop("n_persons", "dominance")}, denial_reasons)


@query("O3_egress", f"""WITH {SALES} SELECT 'unit' AS output, 'identifier_egress,internal_variable_egress,raw_sensitive' AS reasons, COUNT(*) AS n_rows FROM sales
UNION ALL SELECT 'balances', 'internal_variable_egress', COUNT(DISTINCT balance) FROM sales UNION ALL SELECT 'cells', '', COUNT(DISTINCT n_name) FROM sales""")
def o3(spark, d):
    ws = shop.workspace(spark, d)
    return _withheld(ws, {
        "unit": ws.unit("sales"),
        "balances": ws.unit("sales").groupBy("balance").agg(F.count(F.lit(1)).alias("n")),
        "cells": G.release(ws, QuerySpec("sales", Measure("count"), ("n_name",))).released}, egress)


@query("R28_output_contract", f"""WITH {SALES}, n AS (SELECT COUNT(DISTINCT r_name) AS k FROM sales)
SELECT 'r_name' AS column, 'cell_key' AS class, k AS n_cells FROM n UNION ALL SELECT 'value', 'statistic', k FROM n
UNION ALL SELECT 'p_value', 'p_value', k FROM n UNION ALL SELECT 'n', 'count', k FROM n""")
def r28(spark, d):
    """Released columns with their declared class (W5) and how many cells carry them."""
    spec = QuerySpec("sales", Measure("corr", x="o_totalprice", y="c_acctbal"), ("r_name",))
    contract = G.output_contract(spec)
    out = G.check_columns(G.release(shop.workspace(spark, d), spec).released, contract)
    one = out.agg(*(F.count(c).alias(c) for c in out.columns))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(contract[c]).alias("class"),
                                                F.col(c).alias("n_cells")) for c in out.columns))))


@query("H5_value_violations", """WITH o AS (SELECT CAST(o_totalprice AS DECIMAL(12,2)) AS v FROM orders), c AS (SELECT c_mktsegment AS v FROM customer)
SELECT 'orders' AS "table", 'o_totalprice' AS "column", CAST(SUM(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls,
  CAST(SUM(CASE WHEN v NOT BETWEEN 1000 AND 300000 THEN 1 ELSE 0 END) AS BIGINT) AS outside FROM o
UNION ALL SELECT 'customer', 'c_mktsegment', CAST(SUM(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT),
  CAST(SUM(CASE WHEN v NOT IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD') THEN 1 ELSE 0 END) AS BIGINT) FROM c""")
def h5(spark, d):
    """Values of the given tables that a narrower declaration does not account for."""
    ws = shop.workspace(spark, d, shop.study(c_mktsegment=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")))
    tables = {name: ws.tables[name] for name in shop.TABLES}
    bad = violations(tables, ws.study, {"o_totalprice": (1000, 300000)})
    return bad.where(F.col("column").isin("o_totalprice", "c_mktsegment"))


@query("P1_plan_cohorts", f"""WITH {SALES} SELECT 'base' AS stage, COUNT(DISTINCT person) AS n_persons FROM sales
UNION ALL SELECT 'fine', COUNT(DISTINCT person) FROM sales WHERE n_name = 'NATION_7' UNION ALL SELECT 'retry', COUNT(DISTINCT person) FROM sales""")
def p1(spark, d):
    """Stages of a validated plan with the size of the cohort each one reads."""
    ws, out = shop.workspace(spark, d), None
    assert len(PLAN.digest()) == 64 and len({cohort_of(s.spec)[0] for s in PLAN.stages}) == 2
    for stage in PLAN.stages:
        part = C.cohort_size(ws, stage.spec.view, stage.spec.filters).select(F.lit(stage.id).alias("stage"), "n_persons")
        out = part if out is None else out.unionByName(part)
    return out

