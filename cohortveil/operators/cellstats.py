"""ANOVA, Bartlett, Jarque-Bera and series diagnostics from finalised cells.

Finalised cells are written out once; what follows reads that small table, never
the rows behind it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import jarque_bera, jarque_bera_p
from ..functions.tails import chi2_sf, f_sf
from ..session import cut
from ..specs import MAX_LAGS, MIN_WINDOWS, FactorSpec, Measure, QuerySpec, SeriesSpec
from ..study import Policy
from .cells import cells, moment_cells
from .gateway import finalise, rounded, shape
from .measures import ratio
from .models import gaussian_tables
from .rules import fails, judge, not_finite, rule_columns, unresolved_or_above
from .views import Workspace

NAN = float("nan")


def finalised_groups(ws: Workspace, spec: FactorSpec, policy: Policy) -> DataFrame:
    """Per-level n, mean, sum_sq as released, plus ``withheld``."""
    spec.check(ws.study)
    table = gaussian_tables(ws, spec.view, spec.response, [spec.factor], spec.filters, policy)
    return cut(table.select(spec.factor, "mean", "sum_sq", "n",
                            (F.col("fails_mean") | F.col("fails_sum_sq")).alias("withheld")))


def anova_problems(groups: DataFrame) -> DataFrame:
    """Reasons a one-way comparison cannot be made, one row each."""
    row = groups.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
                     F.bool_or("withheld").alias("lost"),
                     F.bool_or(F.col("mean").isNull() | F.col("sum_sq").isNull()).alias("gap"))
    checks = {"nothing released": (F.col("k") == 0) | F.coalesce("lost", F.lit(False)),
              "single level": F.col("k") == 1,
              "missing value": F.coalesce("gap", F.lit(False)),
              "no residual degrees of freedom": F.col("n") - F.col("k") <= 0}
    found = F.array_compact(F.array(*(F.when(c, F.lit(p)) for p, c in checks.items())))
    return row.select(F.explode(found).alias("problem"))


def anova(groups: DataFrame) -> DataFrame:
    """One row: sums of squares, F, eta squared and Bartlett's statistic.

    The grand mean is found first and read as a scalar; everything else is one
    aggregate over the levels.
    """
    n, m, ss = (F.col(c).cast("double") for c in ("n", "mean", "sum_sq"))
    grand = groups.agg((F.sum(n * m) / F.sum(n)).alias("g")).scalar()
    within = F.greatest(F.lit(0.0), ss - n * m * m)
    rows = groups.select(n.alias("n"), m.alias("m"), within.alias("w"), grand.alias("g")).withColumn(
        "v", ratio(F.col("w"), F.col("n") - 1))
    gap = F.col("m") - F.col("g")
    agg = rows.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.max("g").alias("grand_mean"),
        F.sum(F.col("n") * gap * gap).alias("ssb"), F.sum("w").alias("ssw"),
        F.sum((F.col("n") - 1) * F.log(F.when(F.col("v") > 0, F.col("v")))).alias("logs"),
        F.bool_and(F.coalesce(F.col("v") > 0, F.lit(False))).alias("spread"),
        F.sum(ratio(F.lit(1.0), F.col("n") - 1)).alias("inverse"))
    k, total = F.col("k").cast("double"), F.col("n")
    out = agg.withColumn("df_between", (F.col("k") - 1).cast("bigint")).withColumn(
        "df_within", (F.round(total) - F.col("k")).cast("bigint"))
    msw = ratio(F.col("ssw"), F.col("df_within"))
    out = out.withColumn("ms_between", ratio(F.col("ssb"), F.col("df_between"))).withColumn("ms_within", msw)
    f = ratio(F.col("ms_between"), F.when(F.col("ms_within") > 0, F.col("ms_within")))
    correction = 1 + (F.col("inverse") - ratio(F.lit(1.0), F.col("df_within"))) / F.when(k > 1, 3 * (k - 1))
    chi = (F.col("df_within") * F.log(F.when(F.col("ms_within") > 0, F.col("ms_within")))
           - F.col("logs")) / correction
    return out.select(
        F.round(total).cast("bigint").alias("n"), F.col("k").alias("n_groups"), "grand_mean",
        "df_between", "df_within", F.col("ssb").alias("ss_between"), F.col("ssw").alias("ss_within"),
        "ms_between", "ms_within", f.alias("f"),
        ratio(F.col("ssb"), F.col("ssb") + F.col("ssw")).alias("eta_squared"),
        F.when(F.col("spread"), chi).alias("bartlett_chi2"))


def anova_released(groups: DataFrame, factor: str) -> tuple[DataFrame, DataFrame]:
    """The two-row table and the one-row model summary, rounded for release."""
    one = anova(groups)
    p = f_sf(F.col("f"), F.col("df_between").cast("double"), F.col("df_within").cast("double"))
    r = lambda c, k=4: F.round(c, k)
    table = one.select(F.inline(F.array(
        F.struct(F.lit(factor).alias("source"), F.col("df_between").alias("df"),
                 r("ss_between").alias("sum_sq"), r("ms_between").alias("mean_sq"),
                 r("f").alias("statistic"), r(p, 3).alias("p_value")),
        F.struct(F.lit("Residual").alias("source"), F.col("df_within").alias("df"),
                 r("ss_within").alias("sum_sq"), r("ms_within").alias("mean_sq"),
                 F.lit(NAN).alias("statistic"), F.lit(NAN).alias("p_value")))))
    bp = chi2_sf(F.col("bartlett_chi2"), F.col("df_between").cast("double"))
    model = one.select("n", "n_groups", r("grand_mean").alias("grand_mean"),
                       r("eta_squared").alias("eta_squared"), "df_between", "df_within",
                       r("bartlett_chi2").alias("bartlett_chi2"),
                       F.col("df_between").alias("bartlett_df"), r(bp, 3).alias("bartlett_p"))
    return table, model


# -- normality -----------------------------------------------------------------------------

POWER_SUMS = ("sum", "sum_sq", "sum_cube", "sum_quad")


def power_sum_tables(ws: Workspace, spec: FactorSpec, policy: Policy) -> DataFrame:
    """Finalised n and the four power sums per level, which of them each level fails, and its persons."""
    spec.check(ws.study)
    raw = moment_cells(ws, spec.view, spec.response, [spec.factor], spec.filters, degrees=(1, 2, 3, 4))
    shared = reduce(lambda a, b: a | b, rule_columns(["n", "n_persons"], [spec.factor], policy, ws.study).values())
    bad = lambda k: (shared | not_finite(F.col(f"s{k}"))
                     | unresolved_or_above(F.col(f"dominance{k}"), policy.dominance_for(f"moment{k}")))
    return raw.select(spec.factor, rounded(F.col("n"), policy.round_base).alias("n"),
                      *(F.round(f"s{k}", 2).cast("double").alias(name) for k, name in enumerate(POWER_SUMS, 1)),
                      *(bad(k).alias(f"fails_{name}") for k, name in enumerate(POWER_SUMS, 1)),
                      F.col("n_persons").alias("raw_persons"))


def power_sum_cells(ws: Workspace, spec: FactorSpec, policy: Policy) -> DataFrame:
    """Finalised n and the four power sums per level, plus ``withheld``."""
    withheld = reduce(lambda a, b: a | b, (F.col(f"fails_{name}") for name in POWER_SUMS))
    return power_sum_tables(ws, spec, policy).select(spec.factor, "n", *POWER_SUMS, withheld.alias("withheld"))


def shape_columns() -> dict[str, Column]:
    """Skewness, excess kurtosis and Jarque-Bera from n and four power sums.

    NaN below four observations or without spread.
    """
    n = F.col("n").cast("double")
    e1, e2, e3, e4 = (ratio(F.col(c), n) for c in ("sum", "sum_sq", "sum_cube", "sum_quad"))
    m2 = e2 - e1 * e1
    m3 = e3 - 3 * e1 * e2 + 2 * e1 * e1 * e1
    m4 = e4 - 4 * e1 * e3 + 6 * e1 * e1 * e2 - 3 * e1 * e1 * e1 * e1
    ok = (n >= 4) & (m2 > 0)
    safe = F.when(ok, m2)
    skew, kurt = m3 / F.pow(safe, 1.5), m4 / (safe * safe) - 3
    nan = lambda c: F.coalesce(c, F.lit(NAN))
    return {"skewness": nan(skew), "kurtosis": nan(kurt), "jarque_bera": nan(jarque_bera(n, skew, kurt))}


def normality(power_sums: DataFrame, factor: str) -> DataFrame:
    """Per level: n, skewness, kurtosis, Jarque-Bera, df, p, rounded for release."""
    out = power_sums.select(factor, "n", *(c.alias(k) for k, c in shape_columns().items()))
    return out.select(factor, "n", F.round("skewness", 4).alias("skewness"),
                      F.round("kurtosis", 4).alias("kurtosis"),
                      F.round("jarque_bera", 4).alias("jarque_bera"), F.lit(2).alias("df"),
                      F.round(jarque_bera_p(F.col("jarque_bera")), 3).alias("p_value"))


# -- series --------------------------------------------------------------------------------

def judged_windows(ws: Workspace, spec: SeriesSpec, policy: Policy) -> DataFrame:
    """Judged cells of the series, written once, plus ``withheld``."""
    spec.check(ws.study)
    request = QuerySpec(spec.view, Measure(spec.stat, spec.response), (spec.time,), spec.filters)
    return cut(judge(cells(ws, request), (spec.time,), policy, ws.study).withColumn("withheld", fails()))


def series_windows(ws: Workspace, spec: SeriesSpec, policy: Policy, judged: DataFrame | None = None) -> DataFrame:
    """Released window table plus ``withheld``; any withheld window denies the series."""
    judged = judged_windows(ws, spec, policy) if judged is None else judged
    return cut(shape(finalise(judged, (spec.time,), policy), spec.stat))


def series_problems(windows: DataFrame, time: str) -> DataFrame:
    row = windows.agg(F.count(F.lit(1)).alias("k"), F.count_distinct(time).alias("u"),
                      (F.max(time) - F.min(time) + 1).alias("span"),
                      F.bool_or(F.col("value").isNull() | F.isnan("value")).alias("gap"),
                      F.bool_or("withheld").alias("lost"))
    checks = {"nothing released": (F.col("k") == 0) | F.coalesce("lost", F.lit(False)),
              "missing value": F.coalesce("gap", F.lit(False)),
              "too few windows": F.col("k") < MIN_WINDOWS,
              "repeated window": F.col("k") != F.col("u"),
              "not contiguous": (F.col("k") == F.col("u")) & (F.col("span") != F.col("k"))}
    found = F.array_compact(F.array(*(F.when(c, F.lit(p)) for p, c in checks.items())))
    return row.select(F.explode(found).alias("problem"))


def _deviations(windows: DataFrame, time: str) -> DataFrame:
    """t (0-based, windows are contiguous), d (deviation from the mean), n, mean."""
    head = windows.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
                                F.min(time).alias("first")).alias("h")).scalar()
    return windows.select(F.col(time).alias("_t"), F.col("value").alias("_v"), head.alias("h")).select(
        (F.col("_t") - F.col("h.first")).cast("bigint").alias("t"),
        (F.col("_v") - F.col("h.mean")).alias("d"), F.col("h.n").alias("n"), F.col("h.mean").alias("mean"))


def trend(windows: DataFrame, time: str) -> DataFrame:
    """One row: n_windows, mean, sd and the least-squares trend on the window index."""
    dev = _deviations(windows, time)
    centre = F.col("t") - (F.col("n") - 1) / 2.0
    s = dev.agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.sum(F.col("d") * F.col("d")).alias("ss"),
                F.sum(centre * centre).alias("stt"), F.sum(centre * F.col("d")).alias("sxy"))
    slope = ratio(F.col("sxy"), F.col("stt"))
    return s.select(
        F.col("n").alias("n_windows"), "mean", F.sqrt(ratio(F.col("ss"), F.col("n") - 1)).alias("sd"),
        slope.alias("trend_slope"), (F.col("mean") - slope * (F.col("n") - 1) / 2.0).alias("trend_intercept"),
        ratio(slope * slope * F.col("stt"), F.col("ss")).alias("trend_r_squared"))


def autocorrelation(windows: DataFrame, time: str) -> DataFrame:
    """lag, acf for lags 1..min(4, n÷3)."""
    dev = _deviations(windows, time)
    later = dev.select(F.col("t").alias("u"), F.col("d").alias("e"))
    lags = F.sequence(F.lit(1), F.lit(MAX_LAGS))
    pairs = (dev.select("t", "d", "n", F.explode(lags).alias("lag"))
             .where(F.col("lag") <= F.floor(F.col("n") / 3))
             .join(later, F.col("u") == F.col("t") + F.col("lag")))
    ss = dev.agg(F.sum(F.col("d") * F.col("d")).alias("ss")).scalar()
    return (pairs.groupBy("lag").agg(F.sum(F.col("d") * F.col("e")).alias("c"))
            .select("lag", F.coalesce(ratio(F.col("c"), ss), F.lit(NAN)).alias("acf")))


def periodogram(windows: DataFrame, time: str) -> DataFrame:
    """frequency, power for frequencies 1..n÷2 of the demeaned series."""
    dev = _deviations(windows, time)
    each = dev.select("t", "d", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.floor(F.col("n") / 2))).alias("j"))
    angle = F.lit(2.0) * F.pi() * F.col("j") * F.col("t") / F.col("n")
    sums = each.groupBy("j").agg(F.sum(F.col("d") * F.cos(angle)).alias("c"),
                                 F.sum(F.col("d") * F.sin(angle)).alias("s"))
    return sums.select(F.col("j").alias("frequency"), (F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("power"))


def dominant_period(windows: DataFrame, time: str) -> DataFrame:
    """Period of the strongest frequency (ties: the lower one) and its share."""
    best = F.max(F.struct("power", (-F.col("frequency")).alias("minus")))
    n = windows.agg(F.count(F.lit(1)).alias("n")).scalar()
    one = periodogram(windows, time).agg(best.alias("b"), F.sum("power").alias("total"))
    live = F.col("total") > 0
    return one.select(
        F.coalesce(F.when(live, n / (-F.col("b.minus"))), F.lit(NAN)).alias("dominant_period"),
        F.coalesce(F.when(live, ratio(F.col("b.power"), F.col("total"))), F.lit(NAN)).alias("dominant_period_share"))


def series_diagnostics(windows: DataFrame, time: str) -> DataFrame:
    """quantity, value: everything above in one long table, four decimals."""
    def melt(df, names):
        return df.select(F.inline(F.array(*(F.struct(
            F.lit(n).alias("quantity"), F.col(n).cast("double").alias("value")) for n in names))))

    lags = autocorrelation(windows, time).select(
        F.concat(F.lit("acf_lag_"), F.col("lag").cast("string")).alias("quantity"), F.col("acf").alias("value"))
    flat = (melt(trend(windows, time), ("n_windows", "mean", "sd", "trend_slope", "trend_intercept", "trend_r_squared"))
            .unionByName(lags)
            .unionByName(melt(dominant_period(windows, time), ("dominant_period", "dominant_period_share"))))
    return flat.select("quantity", F.round(F.coalesce("value", F.lit(NAN)), 4).alias("value"))
