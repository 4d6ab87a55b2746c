"""Statistics over released tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import following_min, rank_rows, running_sum


def jarque_bera(n: Column, skewness: Column, kurtosis: Column) -> Column:
    """n/6 (S² + K²/4) with excess kurtosis K."""
    return n / 6.0 * (skewness * skewness + kurtosis * kurtosis / 4.0)


def jarque_bera_p(jb: Column) -> Column:
    """Chi-square tail with two degrees of freedom, in closed form."""
    return F.exp(-jb / 2.0)


def adjust_p_values(tests: DataFrame, p: str = "p_value", out: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg adjustment over the whole table.

    Missing p-values stay missing and do not count.  Equal p-values share one
    adjusted value, so the ordered work runs on distinct p-values only.
    """
    live = F.col(p).isNotNull() & ~F.isnan(p)
    levels = tests.where(live).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_k"))
    ranked = running_sum(levels, (), ["_p"], F.col("_k"), "_upto")
    family = tests.where(live).agg(F.count(F.lit(1)).alias("m")).scalar()
    scaled = ranked.withColumn("_scaled", F.col("_p") * family / F.col("_upto"))
    low = following_min(scaled, ["_p"], F.col("_scaled"), "_low")
    levels = low.select("_p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "_low")).alias(out))
    return tests.join(levels, F.col(p) == F.col("_p"), "left").drop("_p")


def spearman(df: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """Rank correlation over a table; ties are ranked in the order of ``tie``.

    One row: n, rho (0 when a rank has no spread).
    """
    base = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y, tie)
    both = rank_rows(rank_rows(base, [x, tie], out="_rx"), [y, tie], out="_ry")
    return both.agg(F.count(F.lit(1)).alias("n"), *_moments("_rx", "_ry")).select(
        "n", F.coalesce(_centred_r(), F.lit(0.0)).alias("rho"))


def _moments(x: str, y: str) -> list[Column]:
    # exact integer power sums of ranks
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return [F.sum(wide(x)).alias("sx"), F.sum(wide(y)).alias("sy"),
            F.sum(wide(x) * wide(x)).alias("sxx"), F.sum(wide(y) * wide(y)).alias("syy"),
            F.sum(wide(x) * wide(y)).alias("sxy")]


def _centred_r() -> Column:
    d = lambda c: F.col(c).cast("double")
    n = d("n")
    spread = (n * d("sxx") - d("sx") * d("sx")) * (n * d("syy") - d("sy") * d("sy"))
    return (n * d("sxy") - d("sx") * d("sy")) / F.sqrt(F.when(spread > 0, spread))


def quantile_summary(df: DataFrame, value: str) -> DataFrame:
    """n, median, p90 and maximum by nearest rank: position ⌊q·n⌋, last at most.

    Equal values are counted first; the ordered scan sees distinct values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_k"))
    total = df.agg(F.count(value).alias("n")).scalar()
    spots = running_sum(counted, (), [value], F.col("_k"), "_upto").withColumn("_n", total)
    at = lambda q: F.min(F.when(
        F.col("_upto") > F.least(F.floor(F.lit(q) * F.col("_n")), F.col("_n") - 1), F.col(value)))
    return spots.agg(F.max("_n").alias("n"), at(0.5).alias("median"), at(0.9).alias("p90"),
                     F.max(value).alias("max"))


def separability(samples: DataFrame, group: str, value: str, pairs: DataFrame) -> DataFrame:
    """For pairs (a, b) of groups: samples needed to tell their medians apart.

    (2·sd/gap)² with the gap of the medians and the population deviation of
    both groups together; infinite without a gap, 1 without spread.  Medians are read off
    counts of distinct values, so a value that most rows share is one row.
    """
    counts = samples.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias(value)).agg(
        F.count(F.lit(1)).alias("w"))
    upto = running_sum(counts, [group], [value], F.col("w"), "upto")
    size = samples.groupBy(group).agg(
        F.count(value).cast("double").alias("k"), F.avg(value).cast("double").alias("mean"),
        F.var_pop(value).alias("var"))
    # the one or two middle places, each held by one distinct value
    places = F.array(F.floor((F.col("k") + 1) / 2), F.ceil((F.col("k") + 1) / 2))
    middle = (upto.join(size, group).withColumn("place", F.explode(places))
              .where((F.col("place") <= F.col("upto")) & (F.col("place") > F.col("upto") - F.col("w"))))
    medians = middle.groupBy(group).agg(
        F.avg(value).alias("med"), F.max("k").alias("k"), F.max("mean").alias("mean"),
        F.max("var").alias("var"))
    side = lambda p: medians.select(F.col(group).alias(p), *(F.col(c).alias(f"{p}_{c}")
                                                           for c in ("med", "k", "mean", "var")))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    c = F.col
    n = c("a_k") + c("b_k")
    mean = (c("a_k") * c("a_mean") + c("b_k") * c("b_mean")) / n
    pooled = (c("a_k") * (c("a_var") + (c("a_mean") - mean) * (c("a_mean") - mean))
              + c("b_k") * (c("b_var") + (c("b_mean") - mean) * (c("b_mean") - mean))) / n
    gap, sd = F.abs(c("a_med") - c("b_med")), F.sqrt(pooled)
    needed = (F.when(gap == 0, F.lit(float("inf"))).when(sd == 0, F.lit(1.0))
              .otherwise((sd * 2 / F.when(gap != 0, gap)) * (sd * 2 / F.when(gap != 0, gap))))
    return joined.select("a", "b", gap.alias("gap"), needed.alias("samples_needed"))


def standardised_means(df: DataFrame, group: str, stratum: str, value: Column) -> DataFrame:
    """Mean per group as if every group had the overall stratum shares.

    A stratum a group lacks contributes nothing, as in a table with a gap.
    """
    cell = df.groupBy(group, stratum).agg(F.avg(value.cast("double")).alias("_mean"),
                                          F.count(F.lit(1)).alias("_k"))
    weights = cell.groupBy(stratum).agg(F.sum("_k").alias("_w"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (cell.join(weights, stratum).withColumn("_share", F.col("_w") / total)
            .groupBy(group).agg(F.sum(F.col("_mean") * F.col("_share")).alias("adjusted")))


def two_way_means(df: DataFrame, row: str, column: str, levels, value: Column) -> DataFrame:
    """Mean per row level and column level; the column levels are declared."""
    return df.groupBy(row).pivot(column, list(levels)).agg(F.avg(value.cast("double")))


def share_with_total(df: DataFrame, group: str, person: str, value: str) -> DataFrame:
    """Share of persons of each group whose total is positive."""
    per = df.groupBy(group, person).agg(F.sum(value).alias("_t"))
    return per.groupBy(group).agg(F.avg((F.col("_t") > 0).cast("double")).alias("share"))
