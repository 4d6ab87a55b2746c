"""Models and series fitted from released cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortveil.functions.stats import quantile_summary
from cohortveil.operators import cells as C
from cohortveil.operators import cellstats as S
from cohortveil.operators import models as M
from cohortveil.operators import rules as R
from cohortveil.session import cut
from cohortveil.specs import FactorSpec, Filter, GlmSpec, SeriesSpec
from cohortveil.studies import shop
from cohortveil.study import Policy

from .aggregates import SWEEP_DIMS, sweep_sql
from .gateway_checks import BOOST, boosted
from .registry import query
from .sqltext import CLICKS, CUSTOMER_SALES, LINES, SALES, cells, half_up, ring, share

POLICY = Policy()
GAUSS = GlmSpec("sales", "gaussian", "o_totalprice", ("r_name",))
GAUSS2 = GlmSpec("sales", "gaussian", "o_totalprice", ("r_name", "o_orderpriority"))
BINOM = GlmSpec("sales", "binomial", "is_urgent", ("r_name",))
BINOM2 = GlmSpec("sales", "binomial", "is_urgent", ("r_name", "c_mktsegment"))
POISS = GlmSpec("customer_sales", "poisson", "open_orders", ("c_mktsegment",))
POISS2 = GlmSpec("customer_sales", "poisson", "urgent_orders", ("r_name", "c_mktsegment"))


def gauss_cells(source: str, keys: str, column: str, name: str = "g") -> str:
    """Finalised mean, sum_sq and n per level."""
    return f"""{name} AS (SELECT {keys}, CAST({half_up(f'SUM({column})', 'COUNT(*)')} AS DOUBLE) AS mean,
  CAST(round(SUM({column} * {column}), 2) AS DOUBLE) AS sum_sq, {ring('COUNT(*)')} AS n,
  COUNT(DISTINCT person) AS persons FROM {source} GROUP BY {keys})"""


@query("M1_planned_tables", f"""WITH {SALES}, p AS (SELECT n_name, person, COUNT(*) AS k, SUM(o_totalprice) AS c1,
  SUM(o_totalprice * o_totalprice) AS c2 FROM sales GROUP BY ALL),
t AS (SELECT n_name, COUNT(*) AS persons, {share('c1')} AS d1, {share('c2')} AS d2 FROM p GROUP BY n_name)
SELECT n_name, persons < 10 OR d1 > 0.05 AS fails_mean, persons < 10 OR d2 > 0.08 AS fails_sum_sq FROM t""")
def m1(spark, d):
    policy = Policy(dominance=0.05, second_moment_dominance=0.08)
    table = M.gaussian_tables(shop.workspace(spark, d), "sales", "o_totalprice", ["n_name"], (), policy)
    return table.select("n_name", "fails_mean", "fails_sum_sq")


@query("M2_gaussian_cells", f"""WITH {SALES}, {gauss_cells('sales', 'r_name, o_orderpriority', 'o_totalprice')}
SELECT r_name, o_orderpriority, mean, sum_sq, n FROM g""")
def m2(spark, d):
    return M.release_model(shop.workspace(spark, d), GAUSS2).cells


@query("M2_binomial_cells", f"""WITH {SALES}
SELECT r_name, c_mktsegment, {ring('SUM(CASE WHEN is_urgent THEN 1 ELSE 0 END)')} AS k, {ring('COUNT(*)')} AS n
FROM sales GROUP BY ALL""")
def m2_binomial(spark, d):
    return M.release_model(shop.workspace(spark, d), BINOM2).cells


@query("M3_design_columns", f"""WITH {SALES}, d AS (
  SELECT 'c_mktsegment' AS term, c_mktsegment AS level, CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN CASE c_mktsegment WHEN 'MACHINERY' THEN 0 ELSE 1 END ELSE 99 END AS place FROM sales GROUP BY ALL
  UNION ALL SELECT 'order_year', CAST(order_year AS VARCHAR), 0 FROM sales GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY place, level) AS position FROM d)
SELECT term, level, position, CASE WHEN position > 1 THEN row_number() OVER (PARTITION BY position = 1 ORDER BY term, position) END AS col FROM p""")
def m3(spark, d):
    ws = shop.workspace(spark, d, shop.study(c_mktsegment=("MACHINERY", "BUILDING")))
    table = M.gaussian_tables(ws, "sales", "o_totalprice", ["c_mktsegment", "order_year"])
    long = M.as_model_cells(table, "m", "gaussian", ["c_mktsegment", "order_year"])
    return M.level_positions(long, ws.study).select("term", "level", "position", "col")


@query("M4_gaussian_coefficients", f"""WITH {SALES}, {gauss_cells('sales', 'r_name', 'o_totalprice')},
t AS (SELECT SUM(greatest(0.0, sum_sq - n * mean * mean)) / (SUM(n) - COUNT(*)) AS disp FROM g),
r AS (SELECT * FROM g WHERE r_name = 'AFRICA'),
c AS (SELECT '(intercept)' AS term, '' AS level, mean AS b, sqrt(disp / n) AS se FROM r, t
 UNION ALL SELECT 'r_name', g.r_name, g.mean - r.mean, sqrt(disp / g.n + disp / r.n) FROM g, r, t WHERE g.r_name <> 'AFRICA')
SELECT term, level, round(b, 4) AS estimate, round(se, 4) AS std_error, round(b / se, 4) AS statistic FROM c""")
def m4(spark, d):
    out = M.release_model(shop.workspace(spark, d), GAUSS).coefficients
    return out.select("term", "level", "estimate", "std_error", "statistic")


@query("M4_gaussian_two_terms")
def m4_two(spark, d):
    return M.release_model(shop.workspace(spark, d), GAUSS2).coefficients


@query("M5_binomial_coefficients", f"""WITH {SALES}, g AS (SELECT r_name, {ring('SUM(CASE WHEN is_urgent THEN 1 ELSE 0 END)')} AS k,
  {ring('COUNT(*)')} AS n FROM sales GROUP BY r_name),
l AS (SELECT r_name, ln(k * 1.0 / (n - k)) AS b, 1.0 / k + 1.0 / (n - k) AS v FROM g),
r AS (SELECT * FROM l WHERE r_name = 'AFRICA'),
c AS (SELECT '(intercept)' AS term, '' AS level, b, sqrt(v) AS se FROM r
 UNION ALL SELECT 'r_name', l.r_name, l.b - r.b, sqrt(l.v + r.v) FROM l, r WHERE l.r_name <> 'AFRICA')
SELECT term, level, round(b, 4) AS estimate, round(se, 4) AS std_error, round(b / se, 4) AS statistic FROM c""")
def m5(spark, d):
    out = M.release_model(shop.workspace(spark, d), BINOM).coefficients
    return out.select("term", "level", "estimate", "std_error", "statistic")


@query("M5_binomial_two_terms")
def m5_two(spark, d):
    return M.release_model(shop.workspace(spark, d), BINOM2).coefficients


@query("M6_poisson_coefficients", f"""WITH {CUSTOMER_SALES}, g AS (SELECT c_mktsegment, CAST(SUM(open_orders) AS DOUBLE) AS s,
  {ring('COUNT(*)')} AS n FROM customer_sales GROUP BY c_mktsegment),
l AS (SELECT c_mktsegment, ln(s / n) AS b, 1.0 / s AS v FROM g), r AS (SELECT * FROM l WHERE c_mktsegment = 'AUTOMOBILE'),
c AS (SELECT '(intercept)' AS term, '' AS level, b, sqrt(v) AS se FROM r
 UNION ALL SELECT 'c_mktsegment', l.c_mktsegment, l.b - r.b, sqrt(l.v + r.v) FROM l, r WHERE l.c_mktsegment <> 'AUTOMOBILE')
SELECT term, level, round(b, 4) AS estimate, round(se, 4) AS std_error, round(b / se, 4) AS statistic FROM c""")
def m6(spark, d):
    out = M.release_model(shop.workspace(spark, d), POISS).coefficients
    return out.select("term", "level", "estimate", "std_error", "statistic")


@query("M6_poisson_two_terms")
def m6_two(spark, d):
    return M.release_model(shop.workspace(spark, d), POISS2).coefficients


@query("M7_gaussian_summary", f"""WITH {SALES}, {gauss_cells('sales', 'r_name', 'o_totalprice')},
t AS (SELECT SUM(greatest(0.0, sum_sq - n * mean * mean)) AS within, SUM(sum_sq) AS ss, SUM(n * mean) AS ny, SUM(n) AS n, COUNT(*) AS k FROM g)
SELECT CAST(n AS BIGINT) AS n, k AS n_cells, CAST(n - k AS DOUBLE) AS df_resid, round(1 - within / (ss - ny * ny / n), 4) AS r_squared FROM t""")
def m7(spark, d):
    return M.release_model(shop.workspace(spark, d), GAUSS).summary.select("n", "n_cells", "df_resid", "r_squared")


@query("M8_coefficients_only", f"""WITH {SALES}, {gauss_cells('sales', 'r_name', 'o_totalprice')}, r AS (SELECT * FROM g WHERE r_name = 'AFRICA')
SELECT '(intercept)' AS term, '' AS level, round(mean, 3) AS estimate FROM r
UNION ALL SELECT 'r_name', g.r_name, round(g.mean - r.mean, 3) FROM g, r WHERE g.r_name <> 'AFRICA'""")
def m8(spark, d):
    policy = Policy(second_moment_dominance=0.001)
    out = M.release_model(shop.workspace(spark, d), GAUSS, policy).coefficients
    return out.select("term", "level", F.round("estimate", 3).alias("estimate"))


@query("M9_preconditions", f"""WITH {SALES}, a AS (SELECT COUNT(*) AS k, COUNT(DISTINCT order_year) * COUNT(DISTINCT order_month) AS f
  FROM (SELECT DISTINCT order_year, order_month FROM sales)),
b AS (SELECT COUNT(DISTINCT is_urgent) AS u FROM sales WHERE is_urgent)
SELECT 'calendar' AS model_id, 'incomplete grid' AS problem FROM a WHERE k <> f
UNION ALL SELECT 'urgent', 'single level: is_urgent' FROM b WHERE u < 2
UNION ALL SELECT 'priority', 'separated: o_orderpriority'""")
def m9(spark, d):
    ws = shop.workspace(spark, d)
    one = M.gaussian_tables(ws, "sales", "o_totalprice", ["order_year", "order_month"])
    two = M.gaussian_tables(ws, "sales", "o_totalprice", ["is_urgent"], (Filter("is_urgent", "==", True),))
    three = M.binomial_tables(ws, "sales", "is_urgent", ["o_orderpriority"])
    long = (M.as_model_cells(one, "calendar", "gaussian", ["order_year", "order_month"])
            .unionByName(M.as_model_cells(two, "urgent", "gaussian", ["is_urgent"]))
            .unionByName(M.as_model_cells(three, "priority", "binomial", ["o_orderpriority"])))
    long = cut(long)
    return M.preconditions(long, M.level_positions(long, ws.study))


@query("M10_binomial_summary", f"""WITH {SALES}, g AS (SELECT {ring('COUNT(*)')} AS n FROM sales GROUP BY r_name, c_mktsegment)
SELECT 'binomial' AS family, 'logit' AS link, 'is_urgent' AS response, CAST(SUM(n) AS BIGINT) AS n, COUNT(*) AS n_cells,
 CAST(COUNT(*) - 9 AS DOUBLE) AS df_resid FROM g""")
def m10_shape(spark, d):
    """Five regions and five segments: nine parameters."""
    out = M.release_model(shop.workspace(spark, d), BINOM2).summary
    return out.select("family", "link", "response", "n", "n_cells", "df_resid")


@query("M10_model_tables")
def m10(spark, d):
    return M.release_model(shop.workspace(spark, d), BINOM2).summary


ANOVA = FactorSpec("lines", "l_quantity", "ship_year")
ANOVA_SQL = f"""{LINES}, {gauss_cells('lines', 'ship_year', 'l_quantity')},
gm AS (SELECT SUM(n * mean) / SUM(n) AS gm FROM g),
v AS (SELECT n, mean, greatest(0.0, sum_sq - n * mean * mean) AS w, greatest(0.0, sum_sq - n * mean * mean) / (n - 1) AS s2, gm FROM g, gm),
a AS (SELECT COUNT(*) AS k, SUM(n) AS n, MAX(gm) AS grand_mean, SUM(n * (mean - gm) * (mean - gm)) AS ssb, SUM(w) AS ssw,
  SUM((n - 1) * ln(s2)) AS logs, SUM(1.0 / (n - 1)) AS inv FROM v)"""


@query("M11_anova", f"""WITH {ANOVA_SQL}
SELECT CAST(n AS BIGINT) AS n, k AS n_groups, round(grand_mean, 4) AS grand_mean, round(ssb, 4) AS ss_between, round(ssw, 4) AS ss_within,
 round((ssb / (k - 1)) / (ssw / (n - k)), 4) AS f, round(ssb / (ssb + ssw), 6) AS eta_squared FROM a""")
def m11(spark, d):
    ws = shop.workspace(spark, d)
    out = S.anova(S.finalised_groups(ws, ANOVA, POLICY))
    r = lambda c, k=4: F.round(c, k).alias(c)
    return out.select("n", "n_groups", r("grand_mean"), r("ss_between"), r("ss_within"), r("f"), r("eta_squared", 6))


@query("M11_anova_released")
def m11_table(spark, d):
    return S.anova_released(S.finalised_groups(shop.workspace(spark, d), ANOVA, POLICY), "ship_year")[0]


@query("M11_anova_table", f"""WITH {ANOVA_SQL}
SELECT 'ship_year' AS source, CAST(k - 1 AS BIGINT) AS df, round(ssb, 4) AS sum_sq, round(ssb / (k - 1), 4) AS mean_sq FROM a
UNION ALL SELECT 'Residual', CAST(n - k AS BIGINT), round(ssw, 4), round(ssw / (n - k), 4) FROM a""")
def m11_sums(spark, d):
    return m11_table(spark, d).select("source", "df", "sum_sq", "mean_sq")


@query("M12_bartlett", f"""WITH {ANOVA_SQL}
SELECT k - 1 AS bartlett_df, round(((n - k) * ln(ssw / (n - k)) - logs) / (1 + (inv - 1.0 / (n - k)) / (3.0 * (k - 1))), 4) AS bartlett_chi2 FROM a""")
def m12(spark, d):
    model = S.anova_released(S.finalised_groups(shop.workspace(spark, d), ANOVA, POLICY), "ship_year")[1]
    return model.select("bartlett_df", "bartlett_chi2")


@query("M13_anova_problems", f"""WITH {SALES}, t AS (SELECT COUNT(DISTINCT o_orderpriority) AS k FROM sales WHERE o_orderpriority = '5-LOW')
SELECT 'single level' AS problem FROM t WHERE k = 1""")
def m13(spark, d):
    spec = FactorSpec("sales", "o_totalprice", "o_orderpriority", (Filter("o_orderpriority", "==", "5-LOW"),))
    return S.anova_problems(S.finalised_groups(shop.workspace(spark, d), spec, POLICY))


NORMAL = FactorSpec("lines", "l_quantity", "l_returnflag", tool="normality")
POWER_SQL = f"""{LINES}, q AS (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS x FROM lines),
g AS (SELECT l_returnflag, {ring('COUNT(*)')} AS n, CAST(SUM(x) AS DOUBLE) AS s1, CAST(SUM(x*x) AS DOUBLE) AS s2,
  CAST(SUM(x*x*x) AS DOUBLE) AS s3, CAST(SUM(x*x*x*x) AS DOUBLE) AS s4 FROM q GROUP BY 1)"""


@query("M14_normality", f"""WITH {POWER_SQL}, e AS (SELECT l_returnflag, n, s1/n AS m, s2/n AS e2, s3/n AS e3, s4/n AS e4 FROM g),
c AS (SELECT l_returnflag, n, e2 - m*m AS m2, e3 - 3*m*e2 + 2*m*m*m AS m3, e4 - 4*m*e3 + 6*m*m*e2 - 3*m*m*m*m AS m4 FROM e),
j AS (SELECT l_returnflag, n, m3 / power(m2, 1.5) AS sk, m4 / (m2*m2) - 3 AS ku FROM c)
SELECT l_returnflag, n, round(sk, 4) AS skewness, round(ku, 4) AS kurtosis, round(n / 6.0 * (sk*sk + ku*ku/4), 4) AS jarque_bera,
  2 AS df, round(exp(-n / 12.0 * (sk*sk + ku*ku/4)), 3) AS p_value FROM j""")
def m14(spark, d):
    sums = S.power_sum_cells(shop.workspace(spark, d), NORMAL, POLICY)
    return S.normality(sums, "l_returnflag")


@query("M15_power_sum_cells", f"""WITH {POWER_SQL}
SELECT l_returnflag, n, s1 AS sum, s2 AS sum_sq, s3 AS sum_cube, s4 AS sum_quad, FALSE AS withheld FROM g""")
def m15(spark, d):
    return S.power_sum_cells(shop.workspace(spark, d), NORMAL, POLICY)


SERIES = SeriesSpec("clicks", "value", "day", "mean")
SERIES_SQL = f"""{CLICKS}, w AS (SELECT day, CAST({half_up('SUM(value)', 'COUNT(*)')} AS DOUBLE) AS value, {ring('COUNT(*)')} AS n
  FROM clicks GROUP BY day),
h AS (SELECT COUNT(*) AS n, AVG(value) AS mean, MIN(day) AS first FROM w),
dv AS (SELECT w.day - h.first AS t, w.value - h.mean AS d, h.n, h.mean FROM w, h)"""


def _windows(spark, d):
    return S.series_windows(shop.workspace(spark, d), SERIES, POLICY)


@query("M16_series_windows", f"WITH {SERIES_SQL} SELECT day, value, n, FALSE AS withheld FROM w")
def m16(spark, d):
    return _windows(spark, d)


@query("M17_series_problems", f"""WITH {SALES}, t AS (SELECT COUNT(DISTINCT order_month) AS k, MAX(order_month) - MIN(order_month) + 1 AS span
  FROM sales WHERE order_month IN (1, 2, 4)),  p AS (SELECT 1 AS x)
SELECT 'too few windows' AS problem FROM t WHERE k < 4 UNION ALL SELECT 'not contiguous' FROM t WHERE k <> span""")
def m17(spark, d):
    ws = shop.workspace(spark, d, orders=lambda t: t.where(F.col("order_month").isin(1, 2, 4)))
    return S.series_problems(S.series_windows(ws, SeriesSpec("sales", "o_totalprice", "order_month"), POLICY), "order_month")


@query("M18_trend", f"""WITH {SERIES_SQL}, s AS (SELECT MAX(n) AS n, MAX(mean) AS mean, SUM(d*d) AS ss,
  SUM((t - (n-1)/2.0) * (t - (n-1)/2.0)) AS stt, SUM((t - (n-1)/2.0) * d) AS sxy FROM dv)
SELECT n AS n_windows, round(mean, 6) AS mean, round(sqrt(ss/(n-1)), 6) AS sd, round(sxy/stt, 6) AS trend_slope,
 round(mean - sxy/stt*(n-1)/2.0, 6) AS trend_intercept, round(sxy*sxy/stt/ss, 6) AS trend_r_squared FROM s""")
def m18(spark, d):
    out = S.trend(_windows(spark, d), "day")
    return out.select("n_windows", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query("M19_autocorrelation", f"""WITH {SERIES_SQL}, ss AS (SELECT SUM(d*d) AS ss FROM dv)
SELECT b.t - a.t AS lag, round(SUM(a.d * b.d) / MAX(ss.ss), 6) AS acf FROM dv a JOIN dv b ON b.t - a.t BETWEEN 1 AND 4, ss
GROUP BY b.t - a.t""")
def m19(spark, d):
    out = S.autocorrelation(_windows(spark, d), "day")
    return out.select(F.col("lag").cast("bigint").alias("lag"), F.round("acf", 6).alias("acf"))


PERIOD_SQL = f"""{SERIES_SQL}, f AS (SELECT CAST(unnest(range(1, 16)) AS BIGINT) AS j),
z AS (SELECT j, SUM(d * cos(2 * pi() * j * t / n)) AS c, SUM(d * sin(2 * pi() * j * t / n)) AS s FROM dv, f GROUP BY j),
pw AS (SELECT j, c*c + s*s AS power FROM z)"""


@query("M20_periodogram", f"WITH {PERIOD_SQL} SELECT j AS frequency, round(power, 4) AS power FROM pw")
def m20(spark, d):
    return S.periodogram(_windows(spark, d), "day").withColumn("power", F.round("power", 4))


@query("M20_dominant_period", f"""WITH {PERIOD_SQL}, b AS (SELECT j, power FROM pw ORDER BY power DESC, j LIMIT 1)
SELECT round(30.0 / b.j, 4) AS dominant_period, round(b.power / (SELECT SUM(power) FROM pw), 4) AS dominant_period_share FROM b""")
def m20_best(spark, d):
    out = S.dominant_period(_windows(spark, d), "day")
    return out.select(*(F.round(c, 4).alias(c) for c in out.columns))


@query("M20_series_quantities", f"""WITH {SERIES_SQL}, s AS (SELECT MAX(n) AS n, MAX(mean) AS mean, SUM(d*d) AS ss FROM dv)
SELECT 'n_windows' AS quantity, CAST(n AS DOUBLE) AS value FROM s UNION ALL SELECT 'mean', round(mean, 4) FROM s
UNION ALL SELECT 'sd', round(sqrt(ss / (n - 1)), 4) FROM s""")
def m20_quantities(spark, d):
    return S.series_diagnostics(_windows(spark, d), "day").where(F.col("quantity").isin("n_windows", "mean", "sd"))


@query("M20_series_diagnostics")
def m20_all(spark, d):
    return S.series_diagnostics(_windows(spark, d), "day")


@query("M21_refit_from_cells", f"""WITH {SALES}
SELECT COUNT(DISTINCT r_name) + COUNT(DISTINCT o_orderpriority) - 1 AS released, CAST(0 AS BIGINT) AS changed FROM sales""")
def m21(spark, d):
    """Write the released cells, fit them again, count coefficients that differ."""
    ws = shop.workspace(spark, d)
    first = M.release_model(ws, GAUSS2)
    again = M.fit_released(cut(first.cells), GAUSS2, ws.study)
    a, b = cut(first.coefficients), cut(again.coefficients)
    changed = a.exceptAll(b).unionByName(b.exceptAll(a))
    return a.agg(F.count(F.lit(1)).alias("released")).withColumn(
        "changed", changed.agg(F.count(F.lit(1)).alias("n")).scalar())


def releasable_models(spark, d):
    """Cells of every releasable model of two views without filters, finalised and raw."""
    ws, out = shop.workspace(spark, d), None
    # models of one column read the same cells
    for view, column, hits, models in (
            ("sales", "o_totalprice", "is_urgent", (("o_totalprice", "gaussian"), ("is_urgent", "binomial"))),
            ("customer_sales", "total_price", None, (("total_price", "gaussian"),)),
            ("customer_sales", "open_orders", None, (("open_orders", "gaussian"), ("open_orders", "poisson"))),
            ("customer_sales", "urgent_orders", None, (("urgent_orders", "poisson"),))):
        dims = sorted(ws.study.view(view).dims)
        sweep = cut(C.sweep_cells(ws, view, column, degrees=(1,), hits=hits))
        for response, family in models:
            part = M.lattice_models(sweep, dims, ws.study, POLICY, response, family)
            out = part if out is None else out.unionByName(part)
    return ws, cut(out)


def _model_sql(view: str, response: str, family: str, dims) -> str:
    """Names of the releasable models of one response: every cell passes."""
    parts = []
    for keys in C.key_sets([x for x in dims if x != response], 3, 1):
        group = ", ".join(keys)
        c = f"CASE WHEN {response} THEN 1 ELSE 0 END" if family == "binomial" else response
        bad = ("bool_or(p < 10 OR n < 10 OR (s > 0 AND (s < 10 OR hit < 10)))" if family == "binomial"
               else "bool_or(p < 10 OR n < 10 OR dominance > 0.5)")
        parts.append(f"SELECT '{family}:{response}:{'+'.join(keys)}' AS model FROM (SELECT COUNT(*) AS p, SUM(k) AS n, SUM(c) AS s, "
                     f"SUM(CASE WHEN c > 0 THEN 1 ELSE 0 END) AS hit, {share('c')} AS dominance FROM (SELECT {group}, person, COUNT(*) AS k, SUM({c}) AS c "
                     f"FROM {view} GROUP BY {group}, person) GROUP BY {group}) HAVING NOT {bad}")
    return " UNION ALL ".join(parts)


_SMALL_DIMS = ("c_mktsegment", "n_name", "r_name")


@query("M22_releasable_models", f"WITH {SALES}, {CUSTOMER_SALES} " + " UNION ALL ".join(
    _model_sql(*m) for m in (("sales", "o_totalprice", "gaussian", SWEEP_DIMS), ("sales", "is_urgent", "binomial", SWEEP_DIMS),
                             ("customer_sales", "total_price", "gaussian", _SMALL_DIMS), ("customer_sales", "open_orders", "gaussian", _SMALL_DIMS),
                             ("customer_sales", "open_orders", "poisson", _SMALL_DIMS), ("customer_sales", "urgent_orders", "poisson", _SMALL_DIMS))))
def m22_models(spark, d):
    """Every model over up to three dimensions whose cell tables pass the rules whole."""
    _, long = releasable_models(spark, d)
    return long.where(F.col("model_id").endswith(":raw")).select(F.regexp_replace("model_id", ":raw$", "").alias("model")).distinct()


@query("M22_rounding_distortion")
def m22(spark, d):
    """How far counts rounded for release move the coefficients of all releasable models, by family."""
    ws, long = releasable_models(spark, d)
    fitted, solved = M.fit(long, ws.study)
    coefs = cut(M.coefficients(M.level_positions(long, ws.study), solved, M.summaries(fitted, False)))
    name = F.regexp_replace("model_id", ":(raw|released)$", "")
    side = lambda s: coefs.where(F.col("model_id").endswith(":" + s)).select(
        name.alias("model"), "term", "level", F.col("estimate").alias(s))
    both = side("raw").join(side("released"), ["model", "term", "level"])
    delta = both.where("raw <> 0").select(
        F.split("model", ":")[0].alias("family"), F.abs((F.col("released") - F.col("raw")) / F.col("raw")).alias("change"))
    delta, out = cut(delta), None
    for family in ("binomial", "gaussian", "poisson"):
        part = quantile_summary(delta.where(F.col("family") == family), "change").withColumn("family", F.lit(family))
        out = part if out is None else out.unionByName(part)
    return out


SWEEP = f"{SALES}, sweep AS ({sweep_sql('sales', SWEEP_DIMS, 'o_totalprice')})"


@query("M23_dispersion_sensitivity", f"""WITH {SWEEP}, big AS (SELECT dominance1 <= 0.05 AS l, dominance2 <= 0.05 AS s FROM sweep
  WHERE n_persons >= 10 AND dominance1 < CAST('Infinity' AS DOUBLE))
SELECT COUNT(*) AS cells, CAST(SUM(CASE WHEN l THEN 1 ELSE 0 END) AS BIGINT) AS pass_linear,
 CAST(SUM(CASE WHEN l AND NOT s THEN 1 ELSE 0 END) AS BIGINT) AS pass_linear_fail_squared,
 CAST(SUM(CASE WHEN s AND NOT l THEN 1 ELSE 0 END) AS BIGINT) AS pass_squared_fail_linear,
 CAST(SUM(CASE WHEN l AND s THEN 1 ELSE 0 END) AS BIGINT) AS pass_both FROM big""")
def m23(spark, d):
    sweep = C.sweep_cells(shop.workspace(spark, d), "sales", "o_totalprice", SWEEP_DIMS)
    return M.sensitivity(sweep, Policy(dominance=0.05))


def _grid_sql() -> str:
    parts = []
    for keys in C.key_sets(SWEEP_DIMS, 3, 1):
        distinct = [f"COUNT(DISTINCT {k})" for k in keys]
        parts.append(f"SELECT '{'+'.join(keys)}' AS grouping, {' * '.join(distinct)} AS fullgrid, "
                     f"{'least(' + ', '.join(distinct) + ')' if len(keys) > 1 else distinct[0]} AS least_levels FROM sales")
    return " UNION ALL ".join(parts)


@query("M24_model_outcomes", f"""WITH {SWEEP}, grid AS ({_grid_sql()}), s AS (
  SELECT grouping, COUNT(*) AS k, bool_or(n_persons < 10 OR dominance1 > 0.1) AS no_mean,
  bool_or(n_persons < 10 OR dominance2 > 0.1) AS no_square FROM sweep WHERE grouping <> '' GROUP BY grouping),
o AS (SELECT CASE WHEN no_mean OR least_levels < 2 OR k <> fullgrid THEN 'denied' WHEN no_square THEN 'without_dispersion'
  ELSE 'complete' END AS outcome FROM s JOIN grid ON s.grouping = grid.grouping)
SELECT outcome, COUNT(*) AS models FROM o GROUP BY outcome""")
def m24(spark, d):
    sweep = cut(C.sweep_cells(shop.workspace(spark, d), "sales", "o_totalprice", SWEEP_DIMS))
    out = M.outcome_of_groupings(sweep, SWEEP_DIMS, Policy(dominance=0.1))
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("models"))


M25_DIMS = SWEEP_DIMS


def _boost_sweep_sql() -> str:
    parts = []
    for keys in C.key_sets(M25_DIMS, 3):
        group = ", ".join(keys)
        lead = f"{group}, " if keys else ""
        over = f"PARTITION BY {group}" if keys else ""
        tail = f"GROUP BY {group}" if keys else ""
        parts.append(f"""SELECT '{'+'.join(keys)}' AS grouping, COUNT(*) AS persons, {share('c')} AS dominance,
  CAST(SUM(c) AS DOUBLE) AS total, CAST(MAX(c) AS DOUBLE) AS largest,
  CAST(coalesce(MAX(CASE WHEN k = 2 THEN c END), 0) AS DOUBLE) AS second FROM (
  SELECT *, row_number() OVER ({over} ORDER BY c DESC) AS k FROM (
  SELECT {lead}person, SUM({BOOST}) AS c FROM sales GROUP BY {lead}person)) {tail}""")
    return " UNION ALL ".join(parts)


@query("M25_composite_cost", f"""WITH {SALES}, t AS ({_boost_sweep_sql()}), v AS (
  SELECT grouping, persons < 10 OR dominance > 0.5 AS own,
  persons < 10 OR (total - largest - second) < 0.1 * largest OR (largest + second) >= 0.9 * total AS ext FROM t)
SELECT grouping, COUNT(*) AS cells, CAST(SUM(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS own_suppressed,
 CAST(SUM(CASE WHEN own OR ext THEN 1 ELSE 0 END) AS BIGINT) AS union_suppressed FROM v GROUP BY grouping""")
def m25(spark, d):
    """Cells lost when the external rules are added, for every group-by."""
    ws = shop.workspace(spark, d, orders=boosted)
    persons = cut(C.sweep_persons(ws, "sales", "o_totalprice", M25_DIMS, named=False, two=True))
    keys = ("grouping", *M25_DIMS)
    own = R.judge(C.swept_cells(persons, M25_DIMS).select(*keys, "n", "n_persons", F.col("dominance1").alias("dominance")),
                  M25_DIMS, POLICY, ws.study)
    top = R.external_rules(R.top_two(persons, keys, "_c1"))
    a = own.select(*keys, R.fails().alias("own"))
    b = top.select(*(F.col(k).alias("e_" + k) for k in keys), R.fails().alias("ext"))
    both = a.join(b, [F.col(k).eqNullSafe(F.col("e_" + k)) for k in keys])
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return both.groupBy(C.grouping_text(F.col("grouping"), M25_DIMS).alias("grouping")).agg(
        F.count(F.lit(1)).alias("cells"), count(F.col("own")).alias("own_suppressed"),
        count(F.col("own") | F.col("ext")).alias("union_suppressed"))

