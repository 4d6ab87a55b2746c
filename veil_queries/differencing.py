"""Differencing between cohorts and ledgers over a log of releases."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortveil.operators import ledger as L
from cohortveil.operators import lineage as D
from cohortveil.operators.cells import marginals
from cohortveil.operators.predicates import normal_predicates
from cohortveil.specs import Filter
from cohortveil.studies import shop
from cohortveil.study import Policy

from .gateway_checks import HOLED, holed
from .registry import query
from .sqltext import CUSTOMER_SALES, SALES

DELTA = 10
PREDICATES = "array<struct<column:string,op:string,values:array<string>>>"

A = (Filter("r_name", "==", "ASIA"),)
B = (Filter("r_name", "==", "ASIA"), Filter("c_mktsegment", "!=", "BUILDING"))
PA, PB = "r_name = 'ASIA'", "r_name = 'ASIA' AND seg <> 'BUILDING'"


def cohorts(spark, d):
    """Five cohorts per nation: all, solvent, not rich, not pending, and everything again."""
    none = f"CAST(array() AS {PREDICATES})"
    extra = lambda c, op, *v: (f"array(named_struct('column', '{c}', 'op', '{op}', 'values', array("
                               + ", ".join(f"'{x}'" for x in v) + ")))")
    variants = [("all", none), ("solvent", extra("balance", ">=", 0)),
                ("plain", extra("balance", "<=", 7999)),
                ("settled", extra("o_orderstatus", "in", "F", "O")),
                ("every", extra("balance", "<=", 10000))]
    table = ", ".join(f"named_struct('variant', '{v}', 'extra', {e})" for v, e in variants)
    nation = spark.read.schema(shop.SCHEMAS["nation"]).parquet(f"{d}/nation.parquet")
    both = nation.select("n_name", F.inline(F.expr(f"array({table})")))
    mine = F.array(F.struct(F.lit("n_name").alias("column"), F.lit("==").alias("op"),
                            F.array("n_name").alias("values")))
    return both.select(F.concat_ws("|", "n_name", "variant").alias("cohort_id"),
                       F.lit("sales").alias("view"), F.concat(mine.cast(PREDICATES), "extra").alias("predicates"))


COHORT_SQL = f"""{SALES},
variants AS (SELECT * FROM (VALUES ('all', -1000000, 1000000, 'F,O,P'), ('solvent', 0, 1000000, 'F,O,P'),
  ('plain', -1000000, 7999, 'F,O,P'), ('settled', -1000000, 1000000, 'F,O'), ('every', -1000000, 10000, 'F,O,P'))
  v(variant, lo, hi, statuses)),
cohorts AS (SELECT n_name || '|' || variant AS cohort_id, n_name, lo, hi, statuses FROM nation, variants),
combos AS (SELECT person, n_name, balance, CAST(SUM(DISTINCT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END) AS BIGINT) AS code
  FROM sales GROUP BY ALL),
member AS (SELECT c.cohort_id, p.person, CASE WHEN c.statuses = 'F,O' THEN p.code - CASE WHEN p.code >= 4 THEN 4 ELSE 0 END ELSE p.code END AS code
  FROM combos p JOIN cohorts c ON p.n_name = c.n_name AND p.balance BETWEEN c.lo AND c.hi),
members AS (SELECT * FROM member WHERE code > 0),
sizes AS (SELECT cohort_id, COUNT(*) AS k FROM members GROUP BY cohort_id),
large AS (SELECT * FROM sizes WHERE k >= {DELTA}),
common AS (SELECT a.cohort_id AS cohort_a, b.cohort_id AS cohort_b, COUNT(*) AS shared,
  SUM(CASE WHEN a.code = b.code THEN 1 ELSE 0 END) AS same
  FROM members a JOIN members b ON a.person = b.person AND a.cohort_id < b.cohort_id GROUP BY ALL),
diffs AS (SELECT a.cohort_id AS cohort_a, b.cohort_id AS cohort_b,
  CAST(a.k + b.k - coalesce(c.shared, 0) - coalesce(c.same, 0) AS BIGINT) AS n_persons
  FROM large a JOIN large b ON a.cohort_id < b.cohort_id
  LEFT JOIN common c ON c.cohort_a = a.cohort_id AND c.cohort_b = b.cohort_id),
close_pairs AS (SELECT * FROM diffs WHERE n_persons < {DELTA})"""

BOUND_SQL = """
mn AS (SELECT n_name, COUNT(DISTINCT person) AS k FROM sales GROUP BY n_name),
mb AS (SELECT balance, COUNT(DISTINCT person) AS k FROM sales GROUP BY balance),
ms AS (SELECT o_orderstatus AS s, COUNT(DISTINCT person) AS k FROM sales GROUP BY o_orderstatus),
ranges AS (SELECT DISTINCT a.lo AS lo_a, a.hi AS hi_a, b.lo AS lo_b, b.hi AS hi_b FROM variants a, variants b),
rb AS (SELECT lo_a, hi_a, lo_b, hi_b, CAST(SUM(CASE WHEN (balance BETWEEN lo_a AND hi_a) <> (balance BETWEEN lo_b AND hi_b) THEN k ELSE 0 END) AS BIGINT) AS k
  FROM ranges, mb GROUP BY ALL),
bounds AS (SELECT p.cohort_a, p.cohort_b, CAST(rb.k + CASE WHEN a.n_name = b.n_name THEN 0
    ELSE (SELECT SUM(k) FROM mn WHERE mn.n_name = a.n_name OR mn.n_name = b.n_name) END
  + CASE WHEN a.statuses = b.statuses THEN 0 ELSE (SELECT k FROM ms WHERE s = 'P') END AS BIGINT) AS bound
  FROM pairs p JOIN cohorts a ON p.cohort_a = a.cohort_id JOIN cohorts b ON p.cohort_b = b.cohort_id
  JOIN rb ON rb.lo_a = a.lo AND rb.hi_a = a.hi AND rb.lo_b = b.lo AND rb.hi_b = b.hi)"""

PAIRS_SQL = """
pairs AS (SELECT a.cohort_id AS cohort_a, b.cohort_id AS cohort_b FROM cohorts a JOIN cohorts b
  ON a.n_name = b.n_name AND a.cohort_id < b.cohort_id)"""


def same_nation_pairs(table):
    nation = F.element_at(F.col("predicates"), 1)["values"][0]
    a = table.select(F.col("cohort_id").alias("cohort_a"), nation.alias("n"))
    b = table.select(F.col("cohort_id").alias("cohort_b"), nation.alias("n"))
    return a.join(b, "n").where("cohort_a < cohort_b").select("cohort_a", "cohort_b")


def sales_marginals(ws):
    return marginals(ws, ["sales"])


@query("D1_marginal_bound", f"WITH {COHORT_SQL}, {PAIRS_SQL}, {BOUND_SQL} SELECT cohort_a, cohort_b, bound FROM bounds")
def d1(spark, d):
    table = cohorts(spark, d)
    return D.marginal_bounds(same_nation_pairs(table), table, sales_marginals(shop.workspace(spark, d)))


@query("D2_row_difference", f"""WITH {SALES}, t AS (SELECT *, {HOLED} AS seg FROM sales)
SELECT COUNT(DISTINCT person) AS n_persons FROM t WHERE coalesce({PA}, FALSE) <> coalesce({PB}, FALSE)""")
def d2(spark, d):
    return D.row_difference(shop.workspace(spark, d, customer=holed), "sales", A, B)


@query("D2_row_difference_three_valued", f"""WITH {SALES}, t AS (SELECT *, {HOLED} AS seg FROM sales)
SELECT COUNT(DISTINCT person) AS n_persons FROM t
WHERE (({PA}) AND NOT ({PB})) OR (({PB}) AND NOT ({PA}))""")
def d2_sql(spark, d):
    return D.row_difference(shop.workspace(spark, d, customer=holed), "sales", A, B, "three_valued")


@query("D3_person_difference", f"""WITH {SALES}, {CUSTOMER_SALES},
a AS (SELECT DISTINCT person FROM sales WHERE r_name = 'ASIA' AND o_orderpriority = '1-URGENT'),
b AS (SELECT DISTINCT person FROM customer_sales WHERE r_name = 'ASIA' AND c_mktsegment <> 'BUILDING')
SELECT COUNT(*) AS n_persons FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL
  (SELECT * FROM b EXCEPT SELECT * FROM a))""")
def d3(spark, d):
    return D.person_difference(
        shop.workspace(spark, d), "sales",
        (Filter("r_name", "==", "ASIA"), Filter("o_orderpriority", "==", "1-URGENT")), "customer_sales", B)


@query("D4_contribution_difference", f"""WITH {SALES}, {CUSTOMER_SALES},
a AS (SELECT person, SUM(o_totalprice) AS s FROM sales WHERE r_name = 'ASIA' AND o_orderstatus <> 'P' GROUP BY person),
b AS (SELECT person, SUM(total_price) AS s FROM customer_sales WHERE r_name = 'ASIA' GROUP BY person)
SELECT COUNT(*) AS n_persons FROM a FULL OUTER JOIN b ON a.person = b.person
WHERE abs(coalesce(a.s, 0) - coalesce(b.s, 0)) > 0.000001""")
def d4(spark, d):
    return D.contribution_difference(
        shop.workspace(spark, d), "order_value",
        "sales", (*A, Filter("o_orderstatus", "!=", "P")), "customer_sales", A)


@query("D4_contribution_differences_of_pairs", f"""WITH {SALES}, {CUSTOMER_SALES},
a AS (SELECT n_name, person, SUM(o_totalprice) AS s FROM sales WHERE o_orderstatus IN ('F','O') GROUP BY ALL),
b AS (SELECT n_name, person, SUM(total_price) AS s FROM customer_sales GROUP BY ALL)
SELECT b.n_name || '|settled' AS cohort_a, b.n_name || '|whole' AS cohort_b,
  CAST(SUM(CASE WHEN abs(coalesce(a.s, 0) - coalesce(b.s, 0)) > 0.000001 THEN 1 ELSE 0 END) AS BIGINT) AS n_persons
FROM a FULL OUTER JOIN b ON a.person = b.person AND a.n_name = b.n_name GROUP BY b.n_name""")
def d4_pairs(spark, d):
    one = cohorts(spark, d).where(F.col("cohort_id").endswith("|settled"))
    name = F.substring_index("cohort_id", "|", 1)
    two = one.select(F.concat(name, F.lit("|whole")).alias("cohort_id"), F.lit("customer_sales").alias("view"),
                     F.slice("predicates", 1, 1).alias("predicates"))
    pairs = one.select(F.col("cohort_id").alias("cohort_a"), F.concat(name, F.lit("|whole")).alias("cohort_b"))
    return D.cross_view_differences(shop.workspace(spark, d), "order_value", pairs, one.unionByName(two))


@query("D5_combined_bound", f"""WITH {COHORT_SQL}, {PAIRS_SQL}, {BOUND_SQL}
SELECT b.cohort_a, b.cohort_b, CASE WHEN b.bound < {DELTA} THEN 'marginal' WHEN x.n_persons < {DELTA} THEN 'exact'
  ELSE 'allow' END AS decided_by, CASE WHEN b.bound < {DELTA} THEN b.bound WHEN x.n_persons < {DELTA} THEN x.n_persons END AS n_persons
FROM bounds b JOIN diffs x ON b.cohort_a = x.cohort_a AND b.cohort_b = x.cohort_b""")
def d5(spark, d):
    ws, table = shop.workspace(spark, d), cohorts(spark, d)
    bounds = D.marginal_bounds(same_nation_pairs(table), table, sales_marginals(ws))
    open_ = bounds.where(F.col("bound") >= DELTA)
    index = D.CohortIndex(ws, "sales", table, ["n_name", "balance", "o_orderstatus"])
    exact = D.exact_differences(index, open_, DELTA)
    joined = bounds.join(exact, ["cohort_a", "cohort_b"], "left")
    return joined.select(
        "cohort_a", "cohort_b",
        F.when(F.col("bound") < DELTA, "marginal").when(F.col("n_persons").isNotNull(), "exact")
        .otherwise("allow").alias("decided_by"),
        F.when(F.col("bound") < DELTA, F.col("bound")).otherwise(F.col("n_persons")).alias("n_persons"))


@query("D9_close_pairs", f"WITH {COHORT_SQL} SELECT * FROM close_pairs")
def d9(spark, d):
    return D.close_pairs(shop.workspace(spark, d), "sales", cohorts(spark, d), DELTA)


WIDE = 30


@query("D9_close_pairs_wide", f"WITH {COHORT_SQL} SELECT * FROM diffs WHERE n_persons < {WIDE}")
def d9_wide(spark, d):
    """A bound far over the release threshold: cohorts between the two stay in."""
    return D.close_pairs(shop.workspace(spark, d), "sales", cohorts(spark, d), WIDE, DELTA)


@query("D9_survey", f"""WITH {COHORT_SQL}, pairs AS (SELECT cohort_a, cohort_b FROM close_pairs), {BOUND_SQL}
SELECT (SELECT COUNT(*) FROM large) AS cohorts, (SELECT COUNT(*) FROM diffs) AS pairs,
  CAST(SUM(CASE WHEN bound < {DELTA} THEN 1 ELSE 0 END) AS BIGINT) AS marginal_denies,
  CAST(SUM(CASE WHEN bound < {DELTA} THEN 0 ELSE 1 END) AS BIGINT) AS exact_only FROM bounds""")
def d9_survey(spark, d):
    ws = shop.workspace(spark, d)
    return D.survey(ws, "sales", cohorts(spark, d), sales_marginals(ws), DELTA)


# -- every cohort of up to two declared values -------------------------------------------

NATIONS = tuple(f"NATION_{k}" for k in range(25))
_LISTED = {"c_mktsegment": shop.SEGMENTS, "n_name": NATIONS, "o_orderpriority": shop.PRIORITIES, "o_orderstatus": shop.STATUSES, "r_name": shop.REGIONS}


def _enumerated_sql() -> str:
    """Names and members of the cohorts: per person a sum that tells its selected combinations."""
    dims, code = sorted(_LISTED), "bit_xor(hash(c_mktsegment, n_name, o_orderpriority, o_orderstatus, r_name))"
    parts = [f"SELECT '' AS cohort_id, person, {code} AS code FROM combos GROUP BY person"]
    for k, one in enumerate(dims):
        parts.append(f"SELECT '{one}=' || {one}, person, {code} FROM combos GROUP BY {one}, person")
        parts += [f"SELECT '{one}=' || {one} || '&{two}=' || {two}, person, {code} FROM combos GROUP BY {one}, {two}, person" for two in dims[k + 1:]]
    return f"""combos AS (SELECT DISTINCT person, {', '.join(dims)} FROM sales),
members AS ({' UNION ALL '.join(parts)}),
sizes AS (SELECT cohort_id, COUNT(*) AS k FROM members GROUP BY cohort_id),
large AS (SELECT * FROM sizes WHERE k >= {DELTA}),
kept AS (SELECT m.* FROM members m JOIN large USING (cohort_id)),
common AS (SELECT a.cohort_id AS cohort_a, b.cohort_id AS cohort_b, COUNT(*) AS shared, SUM(CASE WHEN a.code = b.code THEN 1 ELSE 0 END) AS same
  FROM kept a JOIN kept b ON a.person = b.person AND a.cohort_id < b.cohort_id GROUP BY ALL),
diffs AS (SELECT cohort_a, cohort_b, CAST(a.k + b.k - shared - same AS BIGINT) AS n_persons
  FROM common JOIN large a ON a.cohort_id = cohort_a JOIN large b ON b.cohort_id = cohort_b)"""


@query("D9_enumerated_close_pairs", f"WITH {SALES}, {_enumerated_sql()} SELECT * FROM diffs WHERE n_persons < {DELTA}")
def d9_enumerated(spark, d):
    """Close pairs among all cohorts of up to two declared values of five dimensions."""
    ws = shop.workspace(spark, d, shop.study(n_name=NATIONS))
    return D.close_pairs(ws, "sales", D.enumerated_cohorts(ws, "sales"), DELTA)


@query("D9_enumerated_classes", f"""WITH {SALES}, {_enumerated_sql()},
equal AS (SELECT cohort_a, cohort_b FROM diffs WHERE n_persons = 0)
SELECT cohort_id, least(cohort_id, coalesce((SELECT MIN(cohort_a) FROM equal WHERE cohort_b = cohort_id), cohort_id)) AS class_id FROM large""")
def d9_classes(spark, d):
    """Which of the enumerated cohorts select the same rows."""
    ws = shop.workspace(spark, d, shop.study(n_name=NATIONS))
    return D.close_classes(ws, "sales", D.enumerated_cohorts(ws, "sales"), DELTA)[0]


# -- a log of releases derived from orders: who asked, when, over which cohort -----------

def release_log(spark, d):
    orders = spark.read.schema(shop.SCHEMAS["orders"]).parquet(f"{d}/orders.parquet")
    variant = F.element_at(F.array(*(F.lit(v) for v in ("all", "solvent", "plain", "settled", "every"))),
                           (F.col("o_orderkey") % 5 + 1).cast("int"))
    nation = F.concat(F.lit("NATION_"), (F.floor(F.col("o_orderkey") / 5) % 25).cast("string"))
    return orders.select(
        F.concat(F.lit("u"), (F.col("o_custkey") % 200).cast("string")).alias("user"),
        F.col("o_orderkey").alias("seq"), F.concat_ws("|", nation, variant).alias("cohort_id"),
        F.concat_ws(":", F.lit("sales"), F.lit("mean"), "o_orderpriority").alias("measure"),
        F.round(F.col("o_totalprice") / 100).cast("bigint").alias("persons_total"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 2).otherwise(1).cast("bigint").alias("cost"),
        (F.col("o_orderkey") % 4).cast("bigint").alias("bits"),
        F.when(F.col("o_orderstatus") == "F", "released").when(F.col("o_orderstatus") == "O", "redacted")
        .otherwise("denied").alias("status"))


LOG_SQL = """
log AS (SELECT 'u' || CAST(o_custkey % 200 AS VARCHAR) AS "user", o_orderkey AS seq,
  'NATION_' || CAST(CAST(floor(o_orderkey / 5) AS BIGINT) % 25 AS VARCHAR) || '|' ||
    CASE o_orderkey % 5 WHEN 0 THEN 'all' WHEN 1 THEN 'solvent' WHEN 2 THEN 'plain' WHEN 3 THEN 'settled' ELSE 'every' END AS cohort_id,
  'sales:mean:' || o_orderpriority AS measure, CAST(round(o_totalprice / 100) AS BIGINT) AS persons_total,
  CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END AS BIGINT) AS cost, o_orderkey % 4 AS bits,
  CASE o_orderstatus WHEN 'F' THEN 'released' WHEN 'O' THEN 'redacted' ELSE 'denied' END AS status FROM orders)"""


@query("D6_lineage_denials", f"""WITH {COHORT_SQL}, {LOG_SQL}, both_ways AS (
  SELECT cohort_a AS a, cohort_b AS b FROM close_pairs UNION ALL SELECT cohort_b, cohort_a FROM close_pairs)
SELECT DISTINCT n."user", n.seq FROM log n JOIN both_ways p ON n.cohort_id = p.b
JOIN log e ON e.cohort_id = p.a AND e."user" = n."user" AND e.seq < n.seq AND e.status <> 'denied'""")
def d6(spark, d):
    close = D.close_pairs(shop.workspace(spark, d), "sales", cohorts(spark, d), DELTA)
    return L.lineage_denials(release_log(spark, d), close)


@query("D7_total_deltas", f"""WITH {LOG_SQL}
SELECT DISTINCT n."user", n.seq FROM log n JOIN log e ON e."user" = n."user" AND e.measure = n.measure
 AND e.seq < n.seq AND abs(e.persons_total - n.persons_total) > 0 AND abs(e.persons_total - n.persons_total) < {DELTA}""")
def d7(spark, d):
    return L.total_deltas(release_log(spark, d), DELTA)


@query("D8_measure_keys", """
SELECT CASE WHEN event_type = 'view' THEN 'clicks:corr:' || least('m' || (user_id % 7), 'm' || (user_id % 5))
  || ':' || greatest('m' || (user_id % 7), 'm' || (user_id % 5)) WHEN event_type = 'click' THEN 'clicks:count:*'
  ELSE 'clicks:sum:value' END AS key, COUNT(*) AS n FROM events GROUP BY 1""")
def d8(spark, d):
    events = spark.read.schema(shop.SCHEMAS["events"]).parquet(f"{d}/events.parquet")
    kind = F.col("event_type")
    fn = F.when(kind == "view", "corr").when(kind == "click", "count").otherwise("sum")
    column = F.when(fn == "sum", F.lit("value"))
    name = lambda k: F.concat(F.lit("m"), (F.col("user_id") % k).cast("string"))
    key = L.measure_key(F.lit("clicks"), fn, column, name(7), name(5))
    return events.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("D10_budget", f"""WITH {LOG_SQL}
SELECT "user", seq, CAST(SUM(cost) OVER (PARTITION BY "user" ORDER BY seq) AS BIGINT) AS spent,
  SUM(cost) OVER (PARTITION BY "user" ORDER BY seq) > 20 AS over_budget FROM log""")
def d10(spark, d):
    return L.budget(release_log(spark, d), Policy()).select("user", "seq", "spent", "over_budget")


@query("D11_selection_ledger", f"""WITH RECURSIVE {LOG_SQL}, o AS (SELECT "user", seq, bits,
  row_number() OVER (PARTITION BY "user" ORDER BY seq) AS k FROM log),
r AS (SELECT "user", seq, bits, k, CASE WHEN bits <= 4 THEN bits ELSE 0 END AS spent, bits <= 4 AS accepted FROM o WHERE k = 1
 UNION ALL SELECT o."user", o.seq, o.bits, o.k, CASE WHEN r.spent + o.bits <= 4 THEN r.spent + o.bits ELSE r.spent END, r.spent + o.bits <= 4
 FROM r JOIN o ON o."user" = r."user" AND o.k = r.k + 1)
SELECT "user", seq, bits, accepted FROM r""")
def d11(spark, d):
    return L.charge_selection(release_log(spark, d).select("user", "seq", "bits"), 4)


ACCOUNTING = ("struct<cost:bigint,selection_bits:bigint,"
              "cohorts:array<struct<view:string,cohort_id:string,quantity:string>>>")


@query("D12_session_totals", """
SELECT 'a' || CAST(user_id % 30 AS VARCHAR) AS "user", CAST(SUM(1 + event_id % 3) AS BIGINT) AS spent,
  CAST(SUM(event_id % 2) AS BIGINT) AS selection_spent, COUNT(*) AS records FROM events
WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND event_type <> 'error' GROUP BY 1""")
def d12(spark, d):
    return L.session_totals(audit_rows(spark, d), "2024-01-20 00:00:00")


@query("D12_session_cohorts", """
SELECT DISTINCT 'a' || CAST(user_id % 30 AS VARCHAR) AS "user", 'clicks' AS view, event_type AS cohort_id,
  CASE WHEN event_id % 2 = 0 THEN 'amount' END AS quantity FROM events
WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND event_type <> 'error'""")
def d12_cohorts(spark, d):
    return L.session_cohorts(audit_rows(spark, d), "2024-01-20 00:00:00")


def audit_rows(spark, d):
    """Audit rows as they are stored: accounting is JSON text, read back here."""
    events = spark.read.schema(shop.SCHEMAS["events"]).parquet(f"{d}/events.parquet")
    text = F.to_json(F.struct(
        (F.col("event_id") % 3 + 1).alias("cost"), (F.col("event_id") % 2).alias("selection_bits"),
        F.array(F.struct(F.lit("clicks").alias("view"), F.col("event_type").alias("cohort_id"),
                         F.when(F.col("event_id") % 2 == 0, "amount").alias("quantity"))).alias("cohorts")))
    stored = events.select(
        F.col("event_id").alias("id"), "ts",
        F.concat(F.lit("a"), (F.col("user_id") % 30).cast("string")).alias("user"),
        F.when(F.col("event_type") == "error", "config").otherwise("released").alias("status"),
        text.alias("accounting"))
    from cohortveil.sources.logs import audit_since

    return audit_since(stored, None, {"accounting": ACCOUNTING})


SPARSE = (Filter("n_name", "==", "NATION_7"),)


@query("D13_sparse_levels", f"""WITH {SALES}, k AS (SELECT c_mktsegment AS level, COUNT(DISTINCT person) AS k
  FROM sales WHERE n_name = 'NATION_7' GROUP BY 1)
SELECT l.level, coalesce(k.k, 0) AS n_persons FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'),
 ('MACHINERY'), ('OTHER')) l(level) LEFT JOIN k ON l.level = k.level WHERE coalesce(k.k, 0) < 10""")
def d13(spark, d):
    ws = shop.workspace(spark, d, shop.study(c_mktsegment=(*shop.SEGMENTS, "OTHER")))
    return L.sparse_levels(ws, "sales", "c_mktsegment", SPARSE, Policy())


@query("D14_exclude_sparse", f"""WITH {SALES}, t AS (SELECT *, {HOLED} AS seg FROM sales),
k AS (SELECT seg, COUNT(DISTINCT person) AS k FROM t WHERE n_name = 'NATION_7' GROUP BY 1)
SELECT seg AS c_mktsegment, COUNT(*) AS n FROM t WHERE n_name = 'NATION_7'
 AND seg IN (SELECT seg FROM k WHERE k >= 10 AND seg IS NOT NULL) GROUP BY 1""")
def d14(spark, d):
    ws = shop.workspace(spark, d, shop.study(c_mktsegment=(*shop.SEGMENTS, "OTHER")), customer=holed)
    sparse = L.sparse_levels(ws, "sales", "c_mktsegment", SPARSE, Policy())
    rows = ws.unit("sales").where(F.col("n_name") == "NATION_7")
    return L.without_sparse(rows, "c_mktsegment", sparse).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"))


@query("F8_normal_predicates", """
SELECT list_sort(list_distinct([CASE WHEN hour(ts) = 0 THEN 'day|==|3' ELSE 'day|in|' || least(CAST(hour(ts) AS VARCHAR), '3') || ';'
   || greatest(CAST(hour(ts) AS VARCHAR), '3') END, 'event_type|==|' || event_type])) AS predicates, COUNT(*) AS n
FROM (SELECT CASE WHEN hour(ts) = 3 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE ts END AS ts, event_type FROM events) GROUP BY 1""")
def f8(spark, d):
    events = spark.read.schema(shop.SCHEMAS["events"]).parquet(f"{d}/events.parquet")
    hour = F.when(F.hour("ts").isin(0, 3), F.lit(3)).otherwise(F.hour("ts")).cast("string")
    p = lambda c, op, v: F.struct(F.lit(c).alias("column"), F.lit(op).alias("op"), v.alias("values"))
    raw = F.array(p("day", "in", F.array(hour, F.lit("3"), hour)), p("event_type", "==", F.array("event_type")),
                  p("event_type", "==", F.array("event_type")))
    text = F.transform(normal_predicates(raw), lambda x: F.concat_ws(
        "|", x["column"], x["op"], F.array_join(x["values"], ";")))
    return events.groupBy(text.alias("predicates")).agg(F.count(F.lit(1)).alias("n"))
