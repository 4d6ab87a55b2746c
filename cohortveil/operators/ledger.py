"""Session ledgers over a log of releases: budget, lineage, selection bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scans import running_sum
from ..specs import Filter
from ..study import Policy, StudyError
from .views import Workspace

RELEASED = ("released", "redacted")


def released(log: DataFrame) -> DataFrame:
    return log.where(F.col("status").isin(*RELEASED))


def measure_key(view: Column, fn: Column, column: Column, x: Column, y: Column) -> Column:
    """Identity of what a release measures; the two sides of a correlation commute."""
    corr = F.concat_ws(":", view, fn, F.least(x, y), F.greatest(x, y))
    return F.when(fn == "corr", corr).otherwise(
        F.concat_ws(":", view, fn, F.coalesce(column, F.lit("*"))))


def total_deltas(log: DataFrame, delta: int) -> DataFrame:
    """Releases whose person total is within ``delta`` of an earlier one of the
    same user and measure, but not equal to it.

    Totals are whole numbers: per user and measure only the first sequence
    number of each distinct total matters, and totals are matched in ranges of
    ``delta``, so a row meets at most three ranges of distinct totals.
    """
    key = ["user", "measure"]
    firsts = log.groupBy(*key, F.col("persons_total").alias("earlier")).agg(F.min("seq").alias("first_seq"))
    bucket = lambda c: F.floor(F.col(c) / F.lit(delta))
    near = firsts.withColumn("_b", F.explode(F.array(*(bucket("earlier") + i for i in (-1, 0, 1)))))
    hits = (log.withColumn("_b", bucket("persons_total")).join(near, [*key, "_b"])
            .where((F.col("first_seq") < F.col("seq"))
                   & (F.abs(F.col("earlier") - F.col("persons_total")).between(1, delta - 1))))
    return hits.select("user", "seq").distinct()


def lineage_denials(log: DataFrame, close: DataFrame) -> DataFrame:
    """Releases whose cohort is too close to an earlier released one of the user.

    ``close``: cohort_a, cohort_b pairs below the bound, in one order.  Only the
    first release of a cohort per user is joined, so the work follows the number of close
    pairs, not the number of pairs of releases.
    """
    firsts = released(log).groupBy("user", F.col("cohort_id").alias("earlier")).agg(
        F.min("seq").alias("first_seq"))
    both = close.select("cohort_a", "cohort_b").unionByName(
        close.select(F.col("cohort_b").alias("cohort_a"), F.col("cohort_a").alias("cohort_b")))
    return (log.select("user", "seq", F.col("cohort_id").alias("cohort_b")).join(both, "cohort_b")
            .join(firsts.withColumnRenamed("earlier", "cohort_a"), ["user", "cohort_a"])
            .where("first_seq < seq").select("user", "seq").distinct())


def budget(log: DataFrame, policy: Policy) -> DataFrame:
    """Units spent so far per user and whether each request fits the budget."""
    out = running_sum(log, ["user"], ["seq"], F.col("cost"), "spent")
    return out.withColumn("over_budget", F.col("spent") > policy.budget)


def charge_selection(events: DataFrame, allowed: int) -> DataFrame:
    """Decide every selection charge in order: accepted if it still fits.

    A refused charge spends nothing.  What remains only shrinks, so once a size
    is refused every later charge of that size is refused too, and at most
    ``allowed // bits`` charges of a size are accepted.  Only that many first
    charges per user and size are folded; all others are refused.
    """
    if allowed < 0:
        raise StudyError("the selection budget cannot be negative")
    sized = events.where((F.col("bits") > 0) & (F.col("bits") <= allowed))
    order = W.partitionBy("user", "bits").orderBy("seq")
    few = (sized.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(allowed, 1))
           .where(F.col("_r") * F.col("bits") <= allowed))
    start = F.struct(F.lit(0).cast("bigint").alias("spent"), F.array().cast("array<bigint>").alias("taken"))

    def step(state, event):
        fits = state["spent"] + event["bits"] <= allowed
        return F.struct(
            F.when(fits, state["spent"] + event["bits"]).otherwise(state["spent"]).alias("spent"),
            F.when(fits, F.array_append(state["taken"], event["seq"])).otherwise(state["taken"]).alias("taken"))

    line = F.array_sort(F.collect_list(F.struct(F.col("seq").cast("bigint").alias("seq"),
                                                F.col("bits").cast("bigint").alias("bits"))))
    taken = few.groupBy("user").agg(F.aggregate(line, start, step).alias("s")).select(
        "user", F.explode("s.taken").alias("seq")).withColumn("_ok", F.lit(True))
    return (events.join(taken, ["user", "seq"], "left")
            .withColumn("accepted", (F.col("bits") == 0) | F.coalesce("_ok", F.lit(False))).drop("_ok"))


def session_totals(audit: DataFrame, cutoff) -> DataFrame:
    """Per user since ``cutoff``: units, selection bits and number of releases."""
    live = audit.where((F.col("ts") >= F.lit(cutoff)) & (F.col("status") != "config")
                       & (F.col("user") != ""))
    return live.groupBy("user").agg(
        F.sum("accounting.cost").alias("spent"),
        F.coalesce(F.sum("accounting.selection_bits"), F.lit(0)).alias("selection_spent"),
        F.count(F.lit(1)).alias("records"))


def session_cohorts(audit: DataFrame, cutoff) -> DataFrame:
    """Cohorts each user has released over, one row each."""
    live = audit.where((F.col("ts") >= F.lit(cutoff)) & (F.col("status") != "config")
                       & (F.col("user") != ""))
    return live.select("user", F.inline("accounting.cohorts")).distinct()


def sparse_levels(ws: Workspace, view: str, dim: str, filters: tuple[Filter, ...],
                  policy: Policy) -> DataFrame:
    """Declared levels with fewer than the threshold of persons in a cohort."""
    domain = ws.study.domain(dim)
    if domain is None:
        raise StudyError(f"{dim!r} declares no levels")
    spark = ws.spark(view)
    levels = spark.createDataFrame([(v, i) for i, v in enumerate(domain)], "level string, position int")
    counts = ws.per_person(view, (dim,), filters).groupBy(F.col(dim).cast("string").alias("level")).agg(
        F.count(F.lit(1)).alias("k"))
    return (levels.join(counts, "level", "left")
            .select("level", F.coalesce("k", F.lit(0)).alias("n_persons"))
            .where(F.col("n_persons") < policy.min_persons))


def without_sparse(unit: DataFrame, dim: str, sparse: DataFrame) -> DataFrame:
    """Rows left after excluding every sparse level; a missing level goes too,
    as it satisfies no ``!=`` filter once one is added."""
    kept = unit.join(sparse.select(F.col("level").alias("_level")),
                     F.col(dim).cast("string") == F.col("_level"), "left_anti")
    none = sparse.agg((F.count(F.lit(1)) == 0).alias("none")).scalar()
    return kept.where(F.col(dim).isNotNull() | none)
