"""Statistics over released tables and distribution tails."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortveil.functions import stats, tails
from cohortveil.sources.logs import audit_since
from cohortveil.studies import shop

from .registry import query
from .sqltext import CLICKS, SALES


def orders_p(spark, d):
    """A p-value per order: deterministic, with ties and missing values."""
    orders = spark.read.schema(shop.SCHEMAS["orders"]).parquet(f"{d}/orders.parquet")
    p = F.when(F.col("o_orderkey") % 17 != 0, (F.pmod(F.col("o_orderkey") * 7919, F.lit(1000)) + 1) / 1000.0)
    return orders.select(F.col("o_orderkey").alias("test_id"), p.cast("double").alias("p_value"))


@query("X7_adjusted_p_values", """
WITH t AS (SELECT o_orderkey AS test_id, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(((o_orderkey * 7919) % 1000 + 1) / 1000.0 AS DOUBLE) END AS p_value FROM orders),
m AS (SELECT COUNT(*) AS m FROM t WHERE p_value IS NOT NULL),
r AS (SELECT test_id, p_value, p_value * m.m / row_number() OVER (ORDER BY p_value, test_id) AS s,
  row_number() OVER (ORDER BY p_value, test_id) AS k FROM t, m WHERE p_value IS NOT NULL),
a AS (SELECT test_id, least(1.0, MIN(s) OVER (ORDER BY k DESC)) AS adj FROM r)
SELECT t.test_id, t.p_value, round(a.adj, 9) AS p_adjusted FROM t LEFT JOIN a ON t.test_id = a.test_id""")
def x7(spark, d):
    return stats.adjust_p_values(orders_p(spark, d)).withColumn("p_adjusted", F.round("p_adjusted", 9))


@query("X8_spearman", """
WITH r AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rx,
  row_number() OVER (ORDER BY o_custkey, o_orderkey) AS ry FROM orders)
SELECT COUNT(*) AS n, round(corr(rx, ry), 9) AS rho FROM r""")
def x8(spark, d):
    orders = spark.read.schema(shop.SCHEMAS["orders"]).parquet(f"{d}/orders.parquet")
    return stats.spearman(orders, "o_totalprice", "o_custkey", "o_orderkey").withColumn(
        "rho", F.round("rho", 9))


@query("X9_separability", f"""WITH {CLICKS}, types AS (SELECT DISTINCT event_type AS g FROM clicks),
pairs AS (SELECT a.g AS a, b.g AS b FROM types a JOIN types b ON a.g < b.g),
m AS (SELECT event_type AS g, median(CAST(value AS DOUBLE)) AS med FROM clicks GROUP BY 1),
s AS (SELECT p.a, p.b, stddev_pop(CAST(c.value AS DOUBLE)) AS sd FROM pairs p JOIN clicks c ON c.event_type IN (p.a, p.b) GROUP BY ALL)
SELECT s.a, s.b, round(abs(x.med - y.med), 6) AS gap, CASE WHEN x.med = y.med THEN CAST('Infinity' AS DOUBLE) WHEN s.sd = 0 THEN 1.0
  ELSE round((2 * s.sd / abs(x.med - y.med)) * (2 * s.sd / abs(x.med - y.med)), 4) END AS samples_needed
FROM s JOIN m x ON x.g = s.a JOIN m y ON y.g = s.b""")
def x9(spark, d):
    clicks = shop.workspace(spark, d).public("clicks").select("event_type", "value")
    types = clicks.select("event_type").distinct()
    # event types are a declared handful of levels
    pairs = types.select(F.col("event_type").alias("a")).join(
        types.select(F.col("event_type").alias("b")), F.col("a") < F.col("b"))
    return stats.separability(clicks, "event_type", "value", pairs).select(
        "a", "b", F.round("gap", 6).alias("gap"), F.round("samples_needed", 4).alias("samples_needed"))


@query("X10_quantiles", f"""WITH {SALES}, r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS k,
  COUNT(*) OVER () AS n FROM sales)
SELECT MAX(n) AS n, CAST(MIN(CASE WHEN k = least(CAST(floor(0.5 * n) AS BIGINT), n - 1) THEN v END) AS DOUBLE) AS median,
 CAST(MIN(CASE WHEN k = least(CAST(floor(0.9 * n) AS BIGINT), n - 1) THEN v END) AS DOUBLE) AS p90, CAST(MAX(v) AS DOUBLE) AS max FROM r""")
def x10(spark, d):
    out = stats.quantile_summary(shop.workspace(spark, d).public("sales"), "o_totalprice")
    return out.select("n", *(F.col(c).cast("double").alias(c) for c in ("median", "p90", "max")))


@query("X11_standardised_means", f"""WITH {SALES}, c AS (SELECT r_name, o_orderpriority, AVG(CAST(o_totalprice AS DOUBLE)) AS m, COUNT(*) AS k FROM sales GROUP BY ALL),
w AS (SELECT o_orderpriority, SUM(k) * 1.0 / (SELECT SUM(k) FROM c) AS w FROM c GROUP BY 1)
SELECT r_name, round(SUM(m * w), 4) AS adjusted FROM c JOIN w ON c.o_orderpriority = w.o_orderpriority GROUP BY r_name""")
def x11(spark, d):
    out = stats.standardised_means(shop.workspace(spark, d).public("sales"), "r_name", "o_orderpriority",
                                   F.col("o_totalprice"))
    return out.withColumn("adjusted", F.round("adjusted", 4))


@query("X12_two_way_means", f"""WITH {SALES}
SELECT r_name, round(AVG(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DOUBLE) END), 4) AS F,
 round(AVG(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DOUBLE) END), 4) AS O,
 round(AVG(CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DOUBLE) END), 4) AS P FROM sales GROUP BY r_name""")
def x12(spark, d):
    out = stats.two_way_means(shop.workspace(spark, d).public("sales"), "r_name", "o_orderstatus",
                              shop.STATUSES, F.col("o_totalprice"))
    return out.select("r_name", *(F.round(s, 4).alias(s) for s in shop.STATUSES))


@query("X12_share_with_total", f"""WITH {CLICKS}, p AS (SELECT event_type, person, SUM(value) AS t FROM clicks GROUP BY ALL)
SELECT event_type, round(AVG(CASE WHEN t > 0 THEN 1.0 ELSE 0.0 END), 9) AS share FROM p GROUP BY event_type""")
def x12_share(spark, d):
    unit = shop.workspace(spark, d).unit("clicks")
    return stats.share_with_total(unit, "event_type", "_person", "value").withColumn("share", F.round("share", 9))


def _tail(name, build):
    @query(name)
    def run(spark, d):
        """The tail evaluated on statistics of every nation's orders."""
        sales = shop.workspace(spark, d).public("sales")
        per = sales.groupBy("n_name").agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col("o_totalprice").cast("double")).alias("m"),
            F.stddev(F.col("o_totalprice").cast("double")).alias("s"))
        z = (F.col("m") - 255000) / (F.col("s") / F.sqrt("n"))
        return per.withColumn("z", z).select("n_name", F.round(build(F.col("z"), F.col("n")), 6).alias("p"))
    return run


_tail("X1_normal_tail", lambda z, n: tails.normal_sf(z))
_tail("X2_student_tail", lambda z, n: tails.student_sf(z, n - 1))
_tail("X3_f_tail", lambda z, n: tails.f_sf(z * z, F.lit(1.0), n - 1))
_tail("X5_regularised_beta", lambda z, n: tails.beta_inc((n - 1) / (n - 1 + z * z), (n - 1) / 2, F.lit(0.5)))


@query("X4_chi_square_tail", f"""WITH {SALES}, p AS (SELECT n_name, COUNT(*) / 100.0 AS x FROM sales GROUP BY n_name)
SELECT n_name, round(exp(-x / 2), 9) AS p FROM p""")
def x4(spark, d):
    per = shop.workspace(spark, d).public("sales").groupBy("n_name").agg((F.count(F.lit(1)) / 100.0).alias("x"))
    return per.select("n_name", F.round(tails.chi2_sf("x", F.lit(2.0)), 9).alias("p"))


@query("X6_jarque_bera", f"""WITH {SALES}, t AS (SELECT n_name, COUNT(*) AS n, AVG(v) AS m, AVG(v*v) AS m2, AVG(v*v*v) AS m3, AVG(v*v*v*v) AS m4
 FROM (SELECT n_name, CAST(order_month AS DOUBLE) AS v FROM sales) GROUP BY 1),
c AS (SELECT n_name, n, m2 - m*m AS v, m3 - 3*m*m2 + 2*m*m*m AS c3, m4 - 4*m*m3 + 6*m*m*m2 - 3*m*m*m*m AS c4 FROM t)
SELECT n_name, round(n / 6.0 * (power(c3 / power(v, 1.5), 2) + power(c4 / (v*v) - 3, 2) / 4.0), 6) AS jarque_bera FROM c""")
def x6(spark, d):
    sales = shop.workspace(spark, d).public("sales").select("n_name", F.col("order_month").cast("double").alias("v"))
    per = sales.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.skewness("v").alias("s"), F.kurtosis("v").alias("k"))
    return per.select("n_name", F.round(stats.jarque_bera(F.col("n"), F.col("s"), F.col("k")), 6).alias("jarque_bera"))


@query("S6_audit_since", """
SELECT event_id AS id, 1 + event_id % 3 AS cost FROM events WHERE ts >= TIMESTAMP '2024-01-25 12:00:00' AND event_id % 10 <> 0""")
def s6(spark, d):
    events = spark.read.schema(shop.SCHEMAS["events"]).parquet(f"{d}/events.parquet")
    text = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(
        F.to_json(F.struct((F.col("event_id") % 3 + 1).alias("cost"))))
    rows = events.select(F.col("event_id").alias("id"), "ts", text.alias("accounting"))
    kept = audit_since(rows, "2024-01-25 12:00:00", {"accounting": "struct<cost:bigint>"})
    return kept.select("id", F.col("accounting.cost").alias("cost"))


# -- tails whose closed forms SQL can state ---------------------------------------------------

def balances(spark, d):
    """Customers with a statistic between 0 and about 2.2."""
    rows = spark.read.schema(shop.SCHEMAS["customer"]).parquet(f"{d}/customer.parquet")
    return rows.select("c_custkey", (F.abs("c_acctbal") / 4500).alias("t"))


BALANCES = "b AS (SELECT c_custkey, abs(c_acctbal) / 4500 AS t FROM customer)"
# terms of the power series of the error function; the 33rd is below 1e-15 for t < 2.5
NORMAL_SERIES = "list_sum([(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * pow(t, 2 * k + 1) / (pow(2, k) * factorial(k::INTEGER) * (2 * k + 1)) FOR k IN range(33)])"


@query("X1_normal_closed_form", f"""WITH {BALANCES} SELECT c_custkey, round(0.5 - {NORMAL_SERIES} / sqrt(2 * pi()), 9) AS p FROM b""")
def x1_closed(spark, d):
    return balances(spark, d).select("c_custkey", F.round(tails.normal_sf("t"), 9).alias("p"))


@query("X2_student_closed_form", f"""WITH {BALANCES} SELECT c_custkey, round(0.5 - atan(t) / pi(), 9) AS one, round(0.5 - t / (2 * sqrt(2 + t * t)), 9) AS two FROM b""")
def x2_closed(spark, d):
    """One and two degrees of freedom."""
    return balances(spark, d).select("c_custkey", F.round(tails.student_sf("t", F.lit(1.0)), 9).alias("one"),
                                     F.round(tails.student_sf("t", F.lit(2.0)), 9).alias("two"))


@query("X3_f_closed_form", f"""WITH {BALANCES} SELECT c_custkey, round(pow(1 + 2 * t / 7, -3.5), 9) AS p FROM b""")
def x3_closed(spark, d):
    """Two and seven degrees of freedom."""
    return balances(spark, d).select("c_custkey", F.round(tails.f_sf("t", F.lit(2.0), F.lit(7.0)), 9).alias("p"))


@query("X5_beta_closed_form", f"""WITH {BALANCES} SELECT c_custkey, round(1 - pow(1 - t / 3, 5), 9) AS one, round(pow(t / 3, 4), 9) AS four FROM b""")
def x5_closed(spark, d):
    """I_x(1, b) and I_x(a, 1)."""
    x = F.col("t") / 3
    return balances(spark, d).select("c_custkey", F.round(tails.beta_inc(x, F.lit(1.0), F.lit(5.0)), 9).alias("one"),
                                     F.round(tails.beta_inc(x, F.lit(4.0), F.lit(1.0)), 9).alias("four"))
