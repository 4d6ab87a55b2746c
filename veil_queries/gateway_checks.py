"""Cell rules, suppression, release and rule-set comparison."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from cohortveil.operators import cells as C
from cohortveil.operators import gateway as G
from cohortveil.operators import rules as R
from cohortveil.operators.models import release_model
from cohortveil.specs import GlmSpec, Measure, QuerySpec
from cohortveil.studies import shop
from cohortveil.study import Policy

from .aggregates import SHOP_KINDS, WHALE, doubles, influence_sql, marginal_sql, whale
from .registry import query
from .sqltext import (CLICKS, CUSTOMER_SALES, LINES, SALES, cells, complementary, ring, share)

POLICY = Policy()
# every cell of a fine table, for checks of the cells themselves
EVERY_CELL = replace(POLICY, max_cells=10_000)
BY_NATION_SEGMENT = ("n_name", "c_mktsegment")
MEAN_ORDER = QuerySpec("sales", Measure("mean", "o_totalprice"), BY_NATION_SEGMENT)
SUM_ORDER = QuerySpec("sales", Measure("sum", "o_totalprice"), BY_NATION_SEGMENT)


def listed(df):
    """failed_rules as sorted text, to compare across engines."""
    return df.withColumn("failed_rules", F.array_join(F.array_sort("failed_rules"), ","))


SUM_CELLS = cells("sales", "n_name, c_mktsegment", "o_totalprice", c=WHALE)
MEAN_CELLS = cells("sales", "n_name, c_mktsegment", "o_totalprice", value="mean")


@query("R1_small_cell", f"""WITH {SALES} SELECT n_name, c_mktsegment, COUNT(DISTINCT person) < 10 AS small
FROM sales GROUP BY n_name, c_mktsegment""")
def r1(spark, d):
    df = C.cells(shop.workspace(spark, d), QuerySpec("sales", Measure("count"), BY_NATION_SEGMENT))
    return df.select(*BY_NATION_SEGMENT, R.small_cell(["n", "n_persons"], POLICY).alias("small"))


@query("R2_dominated_cells", f"""WITH {SALES}, {SUM_CELLS}
SELECT n_name, c_mktsegment, dominance > 0.5 AS dominated FROM cells""")
def r2(spark, d):
    df = C.cells(shop.workspace(spark, d, orders=whale), SUM_ORDER)
    return df.select(*BY_NATION_SEGMENT,
                     R.unresolved_or_above(F.col("dominance"), POLICY.dominance).alias("dominated"))


@query("W2_moment_bound", f"""WITH {SALES}, p AS (
  SELECT n_name, person, SUM(o_totalprice * o_totalprice) AS c FROM sales GROUP BY ALL),
t AS (SELECT n_name, {share('c')} AS dominance FROM p GROUP BY n_name)
SELECT n_name, dominance > 0.04 AS dominated FROM t""")
def w2(spark, d):
    policy = Policy(second_moment_dominance=0.04)
    df = C.cells(shop.workspace(spark, d), QuerySpec("sales", Measure("sum_sq", "o_totalprice"), ("n_name",)))
    bound = policy.dominance_for("moment2")
    return df.select("n_name", R.unresolved_or_above(F.col("dominance"), bound).alias("dominated"))


@query("R3_influenced_cells", f"""WITH {SALES}, {influence_sql('sales', 'n_name, c_mktsegment',
       'CAST(o_totalprice AS DOUBLE)', 'CAST(c_acctbal AS DOUBLE)')}
SELECT n_name, c_mktsegment, influence > 0.1 AS influenced FROM influence""")
def r3(spark, d):
    df = C.cells(shop.workspace(spark, d), QuerySpec(
        "sales", Measure("corr", x="o_totalprice", y="c_acctbal"), BY_NATION_SEGMENT))
    return df.select(*BY_NATION_SEGMENT, R.unresolved_or_above(F.col("influence"), 0.1).alias("influenced"))


def infinite(t):
    """A payload that overflows in one month: values become double, some infinite."""
    return t.withColumn("value", F.when(F.col("event_id") % 997 == 0, float("inf")).otherwise(
        F.col("value").cast("double")))


@query("R4_nonfinite_value", """
SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day,
       bool_or(event_id % 997 = 0) AS bad FROM events GROUP BY ALL""")
def r4(spark, d):
    df = C.cells(shop.workspace(spark, d, events=infinite),
                 QuerySpec("clicks", Measure("sum", "value"), ("event_type", "day")))
    return df.select("event_type", "day", R.not_finite(F.col("value")).alias("bad"))


FOUR = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")


def holed(t):
    return t.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 13 != 0, F.col("c_mktsegment")))


HOLED = "CASE WHEN person % 13 = 0 THEN NULL ELSE c_mktsegment END"


@query("R5_undeclared_key", f"""WITH {SALES}
SELECT seg AS c_mktsegment, COUNT(*) AS n, seg IS NOT NULL AND seg NOT IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD') AS undeclared
FROM (SELECT *, {HOLED} AS seg FROM sales) GROUP BY seg""")
def r5(spark, d):
    ws = shop.workspace(spark, d, shop.study(c_mktsegment=FOUR), customer=holed)
    df = C.cells(ws, QuerySpec("sales", Measure("count"), ("c_mktsegment",)))
    return df.select("c_mktsegment", "n", R.undeclared(F.col("c_mktsegment"), FOUR).alias("undeclared"))


@query("R9_too_granular", f"""WITH {SALES}, t AS (
  SELECT r_name, c_mktsegment, o_orderpriority, COUNT(DISTINCT person) AS p FROM sales GROUP BY ALL)
SELECT CASE WHEN bool_or(p < 10) THEN 'redacted' ELSE 'released' END AS status,
       CASE WHEN SUM(CASE WHEN p >= 10 THEN 1 ELSE 0 END) > 100 THEN 'human' ELSE 'auto' END AS decision,
       CAST(SUM(CASE WHEN p >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS n_cells FROM t""")
def r9(spark, d):
    out = G.release(shop.workspace(spark, d),
                    QuerySpec("sales", Measure("count"), ("r_name", "c_mktsegment", "o_orderpriority")))
    return out.status


@query("R9_review_enforced", f"""WITH {SALES}, t AS (
  SELECT r_name, c_mktsegment, o_orderpriority, COUNT(DISTINCT person) AS p FROM sales GROUP BY ALL),
k AS (SELECT CAST(SUM(CASE WHEN p >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM t)
SELECT CASE WHEN kept > 100 THEN 'review' WHEN kept = 0 THEN 'denied' ELSE 'open' END AS outcome,
  CASE WHEN kept > 100 THEN CAST(0 AS BIGINT) ELSE kept END AS n_released,
  CASE WHEN kept > 100 THEN kept END AS n_too_granular FROM k""")
def r9_enforced(spark, d):
    """Over the bound nothing leaves, and a finding says why."""
    out = G.release(shop.workspace(spark, d),
                    QuerySpec("sales", Measure("count"), ("r_name", "c_mktsegment", "o_orderpriority")))
    left = out.released.agg(F.count(F.lit(1)).alias("n_released"))
    fine = out.findings.where("rule = 'too_granular'").agg(F.max("n_cells")).scalar()
    return left.select(out.outcome.select("outcome").scalar().alias("outcome"), "n_released", fine.alias("n_too_granular"))


@query("R9_model_review", f"""WITH {SALES}, t AS (
  SELECT r_name, c_mktsegment, o_orderpriority, COUNT(DISTINCT person) AS p FROM sales GROUP BY ALL)
SELECT CASE WHEN MIN(p) < 10 THEN 'denied' WHEN COUNT(*) > 100 THEN 'review' ELSE 'released' END AS status FROM t""")
def r9_model(spark, d):
    """The same cells asked for through a model need the same review."""
    spec = GlmSpec("sales", "gaussian", "o_totalprice", ("r_name", "c_mktsegment", "o_orderpriority"))
    status = release_model(shop.workspace(spark, d), spec).status
    orders = shop.workspace(spark, d).tables["orders"]
    return orders.agg(F.count(F.lit(1))).select(F.lit(status).alias("status"))


@query("A7_offset_correlation", f"""WITH {SALES}
SELECT n_name, round(corr(CAST(o_totalprice AS DOUBLE), CAST(c_acctbal AS DOUBLE)), 4) AS r FROM sales GROUP BY n_name""")
def a7_offset(spark, d):
    """Adding a thousand million to both columns changes no correlation."""
    far = lambda c: (F.col(c) + 1_000_000_000).cast("decimal(14,2)")
    ws = shop.workspace(spark, d, orders=lambda t: t.withColumn("o_totalprice", far("o_totalprice")),
                        customer=lambda t: t.withColumn("c_acctbal", far("c_acctbal")))
    table = C.cells(ws, QuerySpec("sales", Measure("corr", x="o_totalprice", y="c_acctbal"), ("n_name",)))
    return table.select("n_name", F.round("value", 4).alias("r"))


@query("R10_failed_rules", f"""WITH {SALES}, {SUM_CELLS}
SELECT n_name, c_mktsegment, concat_ws(',', CASE WHEN dominance > 0.5 THEN 'dominance' END,
  CASE WHEN n_persons < 10 THEN 'small_cell' END,
  CASE WHEN c_mktsegment NOT IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD') THEN 'undeclared_cell_key' END) AS failed_rules
FROM cells""")
def r10(spark, d):
    ws = shop.workspace(spark, d, shop.study(c_mktsegment=FOUR), orders=whale)
    judged = R.judge(C.cells(ws, SUM_ORDER), BY_NATION_SEGMENT, POLICY, ws.study)
    return listed(judged).select(*BY_NATION_SEGMENT, "failed_rules")


@query("R10_findings", f"""WITH {SALES}, {SUM_CELLS}, hits AS (
SELECT 'dominance' AS rule FROM cells WHERE dominance > 0.5 UNION ALL SELECT 'small_cell' FROM cells WHERE n_persons < 10)
SELECT rule, 'high' AS severity, TRUE AS suppressable, COUNT(*) AS n_cells FROM hits GROUP BY rule""")
def r10_findings(spark, d):
    ws = shop.workspace(spark, d, orders=whale)
    return R.findings(R.judge(C.cells(ws, SUM_ORDER), BY_NATION_SEGMENT, POLICY, ws.study))


# one key: at this bound exactly one nation is too small
NATION_BOUND = """(SELECT MIN(p) + 1 FROM (SELECT COUNT(DISTINCT person) AS p FROM sales GROUP BY n_name))"""


def one_small_nation(t):
    """Customers of one nation thinned to five persons, so one cell of 25 is small."""
    return t.where((F.col("c_nationkey") != 7) | (F.col("c_custkey") % 10 == 0))


@query("R11_complementary_one_key", f"""WITH {SALES}, thin AS (
  SELECT s.* FROM sales s JOIN customer c ON s.person = c.c_custkey WHERE c.c_nationkey <> 7 OR s.person % 10 = 0),
base AS (SELECT n_name, COUNT(*) AS n, COUNT(DISTINCT person) < 10 AS out FROM thin GROUP BY n_name),
{complementary('base', ['n_name'])[0]}
SELECT n_name, {ring('n')} AS n FROM cn0 WHERE NOT out""")
def r11(spark, d):
    ws = shop.workspace(spark, d, customer=one_small_nation)
    return G.release(ws, QuerySpec("sales", Measure("count"), ("n_name",))).released


_CTE, _LAST = complementary("base", ["n_name", "c_mktsegment"])


@query("R12_complementary_two_keys", f"""WITH {SALES}, base AS (
  SELECT n_name, c_mktsegment, COUNT(*) AS n, COUNT(DISTINCT person) < 10 AS out FROM sales GROUP BY ALL), {_CTE}
SELECT n_name, c_mktsegment, {ring('n')} AS n FROM {_LAST} WHERE NOT out""")
def r12(spark, d):
    # every cell is looked at here, however many there are
    ws = shop.workspace(spark, d)
    spec = QuerySpec("sales", Measure("count"), BY_NATION_SEGMENT)
    return G.release(ws, spec, EVERY_CELL).released


@query("R13_given_up_cell", f"""WITH {SALES}, t AS (SELECT n_name, c_mktsegment, COUNT(*) AS n FROM sales GROUP BY ALL)
SELECT n_name, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY n_name
  ORDER BY round(n / 5.0), n_name || '|' || c_mktsegment) AS k FROM t) WHERE k = 1""")
def r13(spark, d):
    df = C.cells(shop.workspace(spark, d), QuerySpec("sales", Measure("count"), BY_NATION_SEGMENT))
    choice = F.struct(F.round(F.col("n") / 5).alias("size"), R.cell_text(BY_NATION_SEGMENT).alias("cell"),
                      "c_mktsegment")
    best = df.groupBy("n_name").agg(F.min(choice).alias("choice"))
    return best.select("n_name", "choice.c_mktsegment")


@query("R14_finalised", f"""WITH {SALES}, {MEAN_CELLS}
SELECT n_name, c_mktsegment, value, {ring('n')} AS n FROM cells""")
def r14(spark, d):
    df = C.cells(shop.workspace(spark, d), MEAN_ORDER)
    return G.shape(G.finalise(df, BY_NATION_SEGMENT, POLICY), "mean")


@query("R15_key_text", f"""WITH {SALES}
SELECT coalesce(seg, '') || '|' || CAST(order_year AS VARCHAR) AS cell, COUNT(*) AS n
FROM (SELECT *, {HOLED} AS seg FROM sales) GROUP BY 1""")
def r15(spark, d):
    ws = shop.workspace(spark, d, customer=holed)
    df = C.cells(ws, QuerySpec("sales", Measure("count"), ("c_mktsegment", "order_year")))
    return df.select(R.cell_text(("c_mktsegment", "order_year")).alias("cell"), "n")


_CTE17, _LAST17 = complementary("base", ["n_name", "c_mktsegment"])
FLAGSHIP_SQL = f"""WITH {SALES}, {MEAN_CELLS}, base AS (
  SELECT n_name, c_mktsegment, value, n, n_persons < 10 OR dominance > 0.5 AS out FROM cells), {_CTE17}
SELECT n_name, c_mktsegment, value, {ring('n')} AS n FROM {_LAST17} WHERE NOT out"""


@query("R17_safe_release", FLAGSHIP_SQL)
def r17(spark, d):
    return G.release(shop.workspace(spark, d), MEAN_ORDER, EVERY_CELL).released


@query("R17_safe_release_sum_with_refunds", f"""WITH {SALES}, {SUM_CELLS}, base AS (
  SELECT n_name, c_mktsegment, value, n, n_persons < 10 OR dominance > 0.5 AS out FROM cells), {_CTE17}
SELECT n_name, c_mktsegment, CAST(value AS DOUBLE) AS value, {ring('n')} AS n FROM {_LAST17} WHERE NOT out""")
def r17_sum(spark, d):
    return G.release(shop.workspace(spark, d, orders=whale), SUM_ORDER, EVERY_CELL).released


TOP_TWO = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_name, c_mktsegment ORDER BY c DESC) AS k FROM cells_p),
tops AS (SELECT n_name, c_mktsegment, COUNT(*) AS persons, SUM(c) AS total, MAX(CASE WHEN k = 1 THEN c END) AS largest,
  MAX(CASE WHEN k = 2 THEN c END) AS second FROM ranked GROUP BY n_name, c_mktsegment)"""
TOTAL, LARGEST, SECOND = ("CAST(total AS DOUBLE)", "CAST(largest AS DOUBLE)",
                          "CAST(coalesce(second, 0) AS DOUBLE)")
P_RULE = f"({TOTAL} - {LARGEST} - {SECOND}) < 0.1 * {LARGEST}"
NK_RULE = f"({LARGEST} + {SECOND}) >= 0.9 * {TOTAL}"


def boosted(t):
    """Every 50th customer orders 40 times as much: concentrated but positive."""
    return t.withColumn("o_totalprice", F.when(
        F.col("o_custkey") % 50 == 0, (F.col("o_totalprice") * 40).cast("decimal(16,2)")).otherwise(
        F.col("o_totalprice").cast("decimal(16,2)")))


BOOST = "CASE WHEN person % 50 = 0 THEN 40 * o_totalprice ELSE o_totalprice END"
BOOST_CELLS = cells("sales", "n_name, c_mktsegment", "o_totalprice", c=BOOST)


def _top(spark, d):
    ws = shop.workspace(spark, d, orders=boosted)
    return R.top_two(C.contributions(ws, SUM_ORDER), BY_NATION_SEGMENT)


@query("R19_p_percent_rule", f"""WITH {SALES}, {BOOST_CELLS}, {TOP_TWO}
SELECT n_name, c_mktsegment, {P_RULE} AS fails FROM tops""")
def r19(spark, d):
    df = R.external_rules(_top(spark, d))
    return df.select(*BY_NATION_SEGMENT, F.array_contains("failed_rules", "p-ratio").alias("fails"))


@query("R20_nk_rule", f"""WITH {SALES}, {BOOST_CELLS}, {TOP_TWO}
SELECT n_name, c_mktsegment, {NK_RULE} AS fails FROM tops""")
def r20(spark, d):
    df = R.external_rules(_top(spark, d))
    return df.select(*BY_NATION_SEGMENT, F.array_contains("failed_rules", "nk-rule").alias("fails"))


@query("R21_contributor_threshold", f"""WITH {SALES}, {BOOST_CELLS}, {TOP_TWO}
SELECT n_name, c_mktsegment, persons, persons < 10 AS fails FROM tops""")
def r21(spark, d):
    df = R.external_rules(_top(spark, d))
    return df.select(*BY_NATION_SEGMENT, "persons",
                     F.array_contains("failed_rules", "threshold").alias("fails"))


def _own_and_external(spark, d):
    ws = shop.workspace(spark, d, orders=boosted)
    own = R.judge(C.cells(ws, SUM_ORDER), BY_NATION_SEGMENT, POLICY, ws.study)
    return own, R.external_rules(_top(spark, d))


OWN_OUT, EXT_OUT = "n_persons < 10 OR dominance > 0.5", f"persons < 10 OR {P_RULE} OR {NK_RULE}"


@query("R18_union_of_rule_sets", f"""WITH {SALES}, {BOOST_CELLS}, {TOP_TWO}
SELECT c.n_name, c.c_mktsegment, ({OWN_OUT}) OR ({EXT_OUT}) AS out
FROM cells c JOIN tops t ON c.n_name = t.n_name AND c.c_mktsegment = t.c_mktsegment""")
def r18(spark, d):
    own, external = _own_and_external(spark, d)
    return R.merge_rule_sets(own, external, BY_NATION_SEGMENT).select(
        *BY_NATION_SEGMENT, R.fails().alias("out"))


@query("R23_compare_rule_sets", f"""WITH {SALES}, {BOOST_CELLS}, {TOP_TWO}
SELECT CASE WHEN a AND b THEN 'agree_suppress' WHEN a THEN 'first_stricter' WHEN b THEN 'second_stricter'
  ELSE 'agree_release' END AS class, COUNT(*) AS n_cells FROM (
SELECT {OWN_OUT} AS a, {EXT_OUT} AS b
FROM cells c JOIN tops t ON c.n_name = t.n_name AND c.c_mktsegment = t.c_mktsegment) GROUP BY 1""")
def r23(spark, d):
    own, external = _own_and_external(spark, d)
    return R.compare_rule_sets(own, external, BY_NATION_SEGMENT)


@query("R22_outside_verdicts", f"""WITH {SALES}, t AS (SELECT n_name, COUNT(*) AS n, MIN(person) AS m FROM sales GROUP BY n_name)
SELECT n_name, CASE m % 4 WHEN 0 THEN 'checker_incomplete' WHEN 1 THEN '' WHEN 2 THEN 'nk-rule,p-ratio'
  ELSE 'unnamed' END AS failed_rules FROM t""")
def r22(spark, d):
    ws = shop.workspace(spark, d)
    table = C.cells(ws, QuerySpec("sales", Measure("count"), ("n_name",)))
    first = ws.per_person("sales", ("n_name",)).groupBy("n_name").agg(F.min("_person").alias("m"))
    verdicts = first.where(F.col("m") % 4 != 0).select(
        F.col("n_name").alias("cell"),
        F.when(F.col("m") % 4 == 1, "release").when(F.col("m") % 4 == 2, "p-ratio; NK-Rule ;")
        .otherwise("drop table <x>").alias("rule"))
    return listed(R.apply_verdicts(table, ("n_name",), verdicts)).select("n_name", "failed_rules")


@query("R22_outside_status", f"""WITH {SALES}, t AS (SELECT n_name, MIN(person) AS m FROM sales GROUP BY n_name)
SELECT CASE WHEN bool_or(m % 4 = 0) THEN 'denied' ELSE 'redacted' END AS status FROM t""")
def r22_status(spark, d):
    ws = shop.workspace(spark, d)
    table = C.cells(ws, QuerySpec("sales", Measure("count"), ("n_name",)))
    first = ws.per_person("sales", ("n_name",)).groupBy("n_name").agg(F.min("_person").alias("m"))
    verdicts = first.where(F.col("m") % 4 != 0).select(
        F.col("n_name").alias("cell"), F.when(F.col("m") % 4 == 1, "release").otherwise("p-ratio").alias("rule"))
    return R.verdict_status(R.apply_verdicts(table, ("n_name",), verdicts))


@query("R24_shaped_correlation", f"""WITH {SALES}, {influence_sql('sales', 'n_name',
       'CAST(o_totalprice AS DOUBLE)', 'CAST(c_acctbal AS DOUBLE)')}
SELECT n_name, round(value, 4) AS value, {ring('n')} AS n FROM influence WHERE n_persons >= 10 AND influence <= 0.5""")
def r24(spark, d):
    out = G.release(shop.workspace(spark, d), QuerySpec(
        "sales", Measure("corr", x="o_totalprice", y="c_acctbal"), ("n_name",)))
    return out.released.drop("p_value")


@query("R24_correlation_p_values")
def r24_p(spark, d):
    return G.release(shop.workspace(spark, d), QuerySpec(
        "sales", Measure("corr", x="o_totalprice", y="c_acctbal"), ("r_name", "o_orderpriority"))).released


@query("R25_review_decision", f"""WITH {SALES}, t AS (
  SELECT c_mktsegment, o_orderpriority, order_year, COUNT(DISTINCT person) AS p FROM sales GROUP BY ALL)
SELECT CASE WHEN SUM(CASE WHEN p >= 10 THEN 1 ELSE 0 END) > 100 THEN 'human' ELSE 'auto' END AS decision FROM t""")
def r25(spark, d):
    ws = shop.workspace(spark, d)
    keys = ("c_mktsegment", "o_orderpriority", "order_year")
    judged = R.judge(C.cells(ws, QuerySpec("sales", Measure("count"), keys)), keys, POLICY, ws.study)
    kept = judged.where(~R.fails()).agg(F.count(F.lit(1)).alias("n_cells"))
    fine = kept.where(F.col("n_cells") > POLICY.max_cells).select(
        F.lit("too_granular").alias("rule"), F.lit("medium").alias("severity"),
        F.lit(False).alias("suppressable"), "n_cells")
    return G.review_decision(R.findings(judged).unionByName(fine))


def _published_sql() -> str:
    declared = shop.study().domains
    known = " OR ".join(f"(dim = '{k}' AND value IN ({', '.join(repr(str(v)) for v in vs)}))"
                        for k, vs in declared.items())
    names = ", ".join(repr(k) for k in declared)
    return f"""SELECT view, dim, value, CASE WHEN n_persons >= 10 THEN {ring('n_persons')} END AS n FROM m
WHERE ({known}) OR (dim NOT IN ({names}) AND n_persons >= 10 AND value IS NOT NULL)"""


@query("R26_published_marginals",
       f"WITH {SALES}, {CUSTOMER_SALES}, {LINES}, {CLICKS}, m AS ({marginal_sql(SHOP_KINDS)}) {_published_sql()}")
def r26(spark, d):
    ws = shop.workspace(spark, d)
    return G.published_marginals(C.marginals(ws), ws.study, POLICY)


@query("R27_refusal", f"""WITH {SALES}, t AS (SELECT n_name, COUNT(DISTINCT person) AS p FROM sales
  WHERE order_year = 2001 AND order_month >= 8 GROUP BY n_name)
SELECT CASE WHEN coalesce(SUM(CASE WHEN p >= 10 THEN 1 ELSE 0 END), 0) = 0 THEN 'denied' ELSE 'other' END AS status,
       'deny' AS decision, CAST(0 AS BIGINT) AS n_cells FROM t""")
def r27(spark, d):
    from cohortveil.specs import Filter

    spec = QuerySpec("sales", Measure("count"), ("n_name",),
                     (Filter("order_year", "==", 2001), Filter("order_month", ">=", 8)))
    return G.release(shop.workspace(spark, d), spec).status

