"""Aggregates, person counts, marginals and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortveil.operators import cells as C
from cohortveil.specs import Filter, Measure, QuerySpec
from cohortveil.studies import shop

from .registry import query
from .sqltext import CLICKS, CUSTOMER_SALES, LINES, SALES, cells, share


def doubles(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("double"))
    return df


@query("A1_count", f"""WITH {SALES}
SELECT n_name, c_mktsegment, COUNT(*) AS n, COUNT(DISTINCT person) AS n_persons
FROM sales GROUP BY n_name, c_mktsegment""")
def a1(spark, d):
    return C.cells(shop.workspace(spark, d), QuerySpec("sales", Measure("count"), ("n_name", "c_mktsegment")))


@query("A2_mean", f"WITH {SALES}, {cells('sales', 'n_name, c_mktsegment', 'o_totalprice', value='mean')} "
       "SELECT n_name, c_mktsegment, value, n, n_persons, round(dominance, 9) AS dominance FROM cells")
def a2(spark, d):
    df = C.cells(shop.workspace(spark, d),
                 QuerySpec("sales", Measure("mean", "o_totalprice"), ("n_name", "c_mktsegment")))
    return df.withColumn("value", F.round("value", 2).cast("double")).withColumn(
        "dominance", F.round("dominance", 9))


@query("A3_sum", f"WITH {CLICKS}, {cells('clicks', 'event_type, day', 'value')} "
       "SELECT event_type, day, CAST(value AS DOUBLE) AS value, n, n_persons, round(dominance, 9) AS dominance FROM cells")
def a3(spark, d):
    df = C.cells(shop.workspace(spark, d),
                 QuerySpec("clicks", Measure("sum", "value"), ("event_type", "day")))
    return doubles(df, "value").withColumn("dominance", F.round("dominance", 9))


def _power(name, fn, degree):
    c = "*".join(["CAST(l_quantity AS BIGINT)"] * degree)
    sql = cells("lines", "l_returnflag, c_mktsegment", "l_quantity", c=c)

    @query(name, f"WITH {LINES}, {sql} SELECT l_returnflag, c_mktsegment, CAST(value AS DOUBLE) AS value, n, "
           "n_persons, round(dominance, 9) AS dominance FROM cells")
    def run(spark, d):
        df = C.cells(shop.workspace(spark, d),
                     QuerySpec("lines", Measure(fn, "l_quantity"), ("l_returnflag", "c_mktsegment")))
        return doubles(df, "value").withColumn("dominance", F.round("dominance", 9))


_power("A4_sum_sq", "sum_sq", 2)
_power("A5_sum_cube", "sum_cube", 3)
_power("A6_sum_quad", "sum_quad", 4)

CORR = """CASE WHEN (n*xx - x*x) * (n*yy - y*y) > 0 THEN
  (n*xy - x*y) / sqrt((n*xx - x*x) * (n*yy - y*y)) END"""
X, Y = "CAST(open_price AS DOUBLE)", "CAST(total_price AS DOUBLE)"


@query("A7_corr", f"""WITH {CUSTOMER_SALES}, t AS (
  SELECT n_name, CAST(COUNT(*) AS DOUBLE) AS n, SUM({X}) AS x, SUM({Y}) AS y, SUM({X}*{X}) AS xx,
         SUM({Y}*{Y}) AS yy, SUM({X}*{Y}) AS xy FROM customer_sales GROUP BY n_name)
SELECT n_name, round({CORR}, 6) AS value, CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) AS n_persons FROM t""")
def a7(spark, d):
    df = C.cells(shop.workspace(spark, d),
                 QuerySpec("customer_sales", Measure("corr", x="open_price", y="total_price"), ("n_name",)))
    return df.select("n_name", F.round("value", 6).alias("value"), "n", "n_persons")


B = "CAST(c_acctbal AS DOUBLE)"


@query("A7_corr_far_groups", f"""WITH {CUSTOMER_SALES}, t AS (
  SELECT n_name, CAST(COUNT(*) AS DOUBLE) AS n, SUM({X}) AS x, SUM({B}) AS y, SUM({X}*{X}) AS xx,
         SUM({B}*{B}) AS yy, SUM({X}*{B}) AS xy FROM customer_sales GROUP BY n_name)
SELECT n_name, round({CORR}, 6) AS value, CAST(n AS BIGINT) AS n FROM t""")
def a7_far(spark, d):
    """Balances of every other nation moved up by ten thousand million: r is that of the balances as they are."""
    far = lambda t: t.withColumn("c_acctbal", (F.col("c_acctbal") + F.when(F.col("c_nationkey") % 2 == 0, 10 ** 10).otherwise(0))
                                 .cast("decimal(16,2)"))
    df = C.cells(shop.workspace(spark, d, customer=far),
                 QuerySpec("customer_sales", Measure("corr", x="open_price", y="c_acctbal"), ("n_name",)))
    return df.select("n_name", F.round("value", 6).alias("value"), "n")


@query("A8_largest_cells", f"""WITH {SALES}
SELECT r_name, o_orderpriority, order_year, COUNT(*) AS n FROM sales GROUP BY ALL
ORDER BY n DESC, r_name, o_orderpriority, order_year LIMIT 50""")
def a8(spark, d):
    keys = ("r_name", "o_orderpriority", "order_year")
    df = C.cells(shop.workspace(spark, d), QuerySpec("sales", Measure("count"), keys))
    return C.largest_cells(df, keys, 50).drop("n_persons")


@query("A9_persons_per_cell", f"""WITH {LINES}
SELECT l_returnflag, ship_year, COUNT(DISTINCT person) AS n_persons FROM lines
WHERE l_quantity IS NOT NULL GROUP BY ALL""")
def a9(spark, d):
    return C.person_counts(shop.workspace(spark, d),
                           QuerySpec("lines", Measure("sum", "l_quantity"), ("l_returnflag", "ship_year")))


@query("A10_contributions", f"""WITH {SALES}
SELECT n_name, o_orderstatus, person AS _person, CAST(SUM(o_totalprice) AS DOUBLE) AS contribution, COUNT(*) AS _n
FROM sales WHERE o_totalprice IS NOT NULL GROUP BY n_name, o_orderstatus, person""")
def a10(spark, d):
    df = C.contributions(shop.workspace(spark, d),
                         QuerySpec("sales", Measure("sum", "o_totalprice"), ("n_name", "o_orderstatus")))
    return doubles(df, "contribution")


@query("A11_cohort_size", f"""WITH {SALES}
SELECT COUNT(DISTINCT person) AS n_persons FROM sales
WHERE r_name = 'ASIA' AND o_orderpriority = '1-URGENT' AND order_year >= 1998""")
def a11(spark, d):
    return C.cohort_size(shop.workspace(spark, d), "sales", (
        Filter("r_name", "==", "ASIA"), Filter("o_orderpriority", "==", "1-URGENT"),
        Filter("order_year", ">=", 1998)))


def marginal_sql(views: dict[str, dict[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{v}' AS view, '{dim}' AS dim, '{kind}' AS kind, CAST({dim} AS VARCHAR) AS value, "
        f"COUNT(DISTINCT person) AS n_persons FROM {v} GROUP BY {dim}"
        for v, kinds in views.items() for dim, kind in kinds.items())


SHOP_KINDS = {v: shop.study().view(v).filter_kinds() for v in ("sales", "customer_sales", "lines", "clicks")}


@query("A12_marginals", f"WITH {SALES}, {CUSTOMER_SALES}, {LINES}, {CLICKS} {marginal_sql(SHOP_KINDS)}")
def a12(spark, d):
    return C.marginals(shop.workspace(spark, d))


SWEEP_DIMS = tuple(sorted(shop.study().view("sales").dims))


def sweep_sql(source: str, dims, column: str, widest: int = 3, degrees=(1, 2)) -> str:
    parts = []
    powers = [f"SUM(pow(CAST({column} AS DOUBLE), {p})) AS c{p}" if p > 2 else f"SUM({column}*{column}) AS c2" for p in degrees[1:]]
    for keys in C.key_sets(dims, widest):
        group = ", ".join(keys)
        lead = f"{group}, " if keys else ""
        shown = ", ".join(k if k in keys else f"NULL AS {k}" for k in sorted(dims))
        tail = f"GROUP BY {group}" if keys else ""
        parts.append(f"""SELECT '{'+'.join(keys)}' AS grouping, {shown}, CAST(SUM(k) AS BIGINT) AS n,
  COUNT(*) AS n_persons, SUM(c1) AS s1, {', '.join(f"{share(f'c{p}')} AS dominance{p}" for p in degrees)}
  FROM (SELECT {lead}person, COUNT(*) AS k, SUM({column}) AS c1, {', '.join(powers)}
        FROM {source} GROUP BY {lead}person) {tail}""")
    return " UNION ALL ".join(parts)


@query("A13_sweep_all_groupings", f"""WITH {SALES}, sweep AS ({sweep_sql('sales', SWEEP_DIMS, 'o_totalprice', degrees=(1, 2, 3, 4))})
SELECT grouping, {', '.join(SWEEP_DIMS)}, n, n_persons, CAST(s1 AS DOUBLE) AS s1, round(dominance1, 8) AS dominance1,
  round(dominance2, 8) AS dominance2, round(dominance3, 8) AS dominance3, round(dominance4, 8) AS dominance4 FROM sweep""")
def a13(spark, d):
    """Every group-by of up to three of the view's eight dimensions, for all measures of its column."""
    df = C.sweep_cells(shop.workspace(spark, d), "sales", "o_totalprice", degrees=(1, 2, 3, 4))
    return doubles(df.drop("s2", "s3", "s4"), "s1").withColumns({f"dominance{k}": F.round(f"dominance{k}", 8) for k in (1, 2, 3, 4)})


# -- witnesses ----------------------------------------------------------------------

WHALE = "CASE WHEN person % 97 = 0 THEN -60 * o_totalprice ELSE o_totalprice END"


def whale(t):
    return t.withColumn("o_totalprice", F.when(
        F.col("o_custkey") % 97 == 0, (F.col("o_totalprice") * -60).cast("decimal(16,2)")).otherwise(
        F.col("o_totalprice").cast("decimal(16,2)")))


@query("W1_dominance", f"WITH {SALES}, {cells('sales', 'n_name, c_mktsegment', 'o_totalprice', c=WHALE)} "
       "SELECT n_name, c_mktsegment, n_persons, round(dominance, 9) AS dominance FROM cells")
def w1(spark, d):
    df = C.cells(shop.workspace(spark, d, orders=whale),
                 QuerySpec("sales", Measure("sum", "o_totalprice"), ("n_name", "c_mktsegment")))
    return df.select("n_name", "c_mktsegment", "n_persons", F.round("dominance", 9).alias("dominance"))


def influence_sql(source: str, keys: str, x: str, y: str) -> str:
    def r(n, x_, y_, xx, yy, xy):
        v = f"(({n})*({xx}) - ({x_})*({x_})) * (({n})*({yy}) - ({y_})*({y_}))"
        return f"(({n})*({xy}) - ({x_})*({y_})) / sqrt(CASE WHEN {v} > 0 THEN {v} END)"

    lead = f"{keys}, " if keys else ""
    tail = f"GROUP BY {keys}" if keys else ""
    names = ["n", "x", "y", "xx", "yy", "xy"]
    match = " AND ".join(f"p.{k.strip()} IS NOT DISTINCT FROM t.{k.strip()}" for k in keys.split(",")) if keys else "TRUE"
    shown = "".join(f"t.{k.strip()}, " for k in keys.split(",")) if keys else ""
    full = r(*(f"t.{c}" for c in names))
    rest = r(*(f"t.{c} - p.{c}" for c in names))
    return f"""
pp AS (SELECT {lead}person, CAST(COUNT(*) AS DOUBLE) AS n, SUM({x}) AS x, SUM({y}) AS y, SUM({x}*{x}) AS xx,
       SUM({y}*{y}) AS yy, SUM({x}*{y}) AS xy FROM {source}
       WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {lead}person),
tt AS (SELECT {lead}SUM(n) AS n, SUM(x) AS x, SUM(y) AS y, SUM(xx) AS xx, SUM(yy) AS yy, SUM(xy) AS xy,
       COUNT(*) AS n_persons FROM pp {tail}),
influence AS (SELECT {shown}CAST(t.n AS BIGINT) AS n, t.n_persons, {full} AS value, MAX(COALESCE(CASE WHEN t.n - p.n >= 3
       THEN abs(({full}) - ({rest})) END, CAST('Infinity' AS DOUBLE))) AS influence
       FROM pp p JOIN tt t ON {match} GROUP BY ALL)"""


@query("W3_influence_grouped", f"""WITH {SALES}, {influence_sql('sales', 'n_name, o_orderstatus',
       'CAST(o_totalprice AS DOUBLE)', 'CAST(c_acctbal AS DOUBLE)')}
SELECT n_name, o_orderstatus, n, n_persons, round(value, 6) AS value, round(influence, 6) AS influence FROM influence""")
def w3(spark, d):
    df = C.cells(shop.workspace(spark, d), QuerySpec(
        "sales", Measure("corr", x="o_totalprice", y="c_acctbal"), ("n_name", "o_orderstatus")))
    return df.withColumn("value", F.round("value", 6)).withColumn("influence", F.round("influence", 6))


@query("W3_influence_overall", f"""WITH {CUSTOMER_SALES}, {influence_sql('customer_sales', '',
       'CAST(open_price AS DOUBLE)', 'CAST(urgent_orders AS DOUBLE)')}
SELECT n, n_persons, round(value, 6) AS value, round(influence, 6) AS influence FROM influence""")
def w3_all(spark, d):
    df = C.cells(shop.workspace(spark, d), QuerySpec(
        "customer_sales", Measure("corr", x="open_price", y="urgent_orders")))
    return df.withColumn("value", F.round("value", 6)).withColumn("influence", F.round("influence", 6))


@query("W4_moments_one_pass", f"""WITH {LINES}, p AS (
  SELECT ship_year, person, COUNT(*) AS k, SUM(CAST(l_quantity AS BIGINT)) AS c1,
         SUM(CAST(l_quantity AS BIGINT)*CAST(l_quantity AS BIGINT)) AS c2 FROM lines GROUP BY ALL)
SELECT ship_year, CAST(SUM(k) AS BIGINT) AS n, COUNT(*) AS n_persons, CAST(SUM(c1) AS DOUBLE) AS s1,
       CAST(SUM(c2) AS DOUBLE) AS s2, round({share('c1')}, 9) AS dominance1, round({share('c2')}, 9) AS dominance2
FROM p GROUP BY ship_year""")
def w4(spark, d):
    df = C.moment_cells(shop.workspace(spark, d), "lines", "l_quantity", ("ship_year",))
    return doubles(df, "s1", "s2").withColumn("dominance1", F.round("dominance1", 9)).withColumn(
        "dominance2", F.round("dominance2", 9))

