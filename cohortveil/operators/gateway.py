"""The release gateway: rules, complementary suppression, rounding, status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import pearson_p
from ..session import cut
from ..specs import QuerySpec
from ..study import Policy, Study, StudyError
from .cells import HELPERS, cells
from .measures import PROCEDURES
from .rules import SEVERITY, cell_text, denial_reasons, fails, findings, judge, key_text
from .views import Workspace

SECONDARY = "secondary_suppression"


def rounded(c: Column, base: int) -> Column:
    return (F.round(c / F.lit(base)) * F.lit(base)).cast("bigint")


def _victims(state: DataFrame, margin: list[str], keys, base: int) -> DataFrame:
    """For margins that lack exactly one cell: the keys of the cell given up to protect it.

    The smallest count as released, ties by key text, then by the keys themselves,
    so that a missing key and an empty one stay two cells.
    """
    live = ~F.col("_out")
    choice = F.struct(F.round(F.col("n") / F.lit(base)).alias("size"), cell_text(keys).alias("cell"),
                      F.struct(*(F.col(k).alias(f"v{i}") for i, k in enumerate(keys))).alias("keys"))
    return (state.groupBy(*margin)
            .agg(F.sum(F.col("_out").cast("int")).alias("_gone"),
                 F.min(F.when(live, choice)).alias("_choice"))
            .where((F.col("_gone") == 1) & F.col("_choice").isNotNull())
            .select(*(F.col(f"_choice.keys.v{i}").alias(f"_v{i}") for i in range(len(keys))), F.lit(True).alias("_hit"))
            .distinct())


def _drop(state: DataFrame, victims: DataFrame, keys, sweep: int) -> DataFrame:
    same = [F.col(k).eqNullSafe(F.col(f"_v{i}")) for i, k in enumerate(keys)]
    marked = state.join(victims, same, "left")
    hit = F.coalesce("_hit", F.lit(False))
    return (marked.withColumn("_sweep", F.when(hit & ~F.col("_out"), F.lit(sweep)).otherwise(F.col("_sweep")))
            .withColumn("_out", F.col("_out") | hit)
            .drop("_hit", *(f"_v{i}" for i in range(len(keys)))))


def complementary(judged: DataFrame, keys, policy: Policy) -> DataFrame:
    """Give up further cells so that no margin lacks exactly one.

    One key: the only margin is the grand total, one pass settles it.  Several
    keys: the levels of a dimension are disjoint, so they run in parallel;
    dimensions run in order and the sweep repeats until nothing changes.  Each
    sweep reads the cell table written by the one before.
    """
    keys = list(keys)
    if not keys:
        return judged
    state = judged.withColumn("_out", fails()).withColumn("_sweep", F.lit(0))
    if len(keys) == 1:
        state = _drop(state, _victims(state, [], keys, policy.round_base), keys, 1)
    else:
        sweep = 0
        settled = state.where(F.col("_out")).isEmpty()
        while not settled:
            sweep += 1
            for key in keys:
                state = _drop(state, _victims(state, [key], keys, policy.round_base), keys, sweep)
            state = cut(state)
            settled = state.where(F.col("_sweep") == sweep).isEmpty()
    extra = F.when(F.col("_sweep") > 0, F.array(F.lit(SECONDARY))).otherwise(
        F.array().cast("array<string>"))
    return state.withColumn("failed_rules", F.concat("failed_rules", extra)).drop("_out", "_sweep")


def finalise(released: DataFrame, keys, policy: Policy) -> DataFrame:
    """Drop helper columns, round counts, order by released count and key."""
    out = released.drop(*HELPERS, "failed_rules")
    out = out.withColumn("n", rounded(F.col("n"), policy.round_base))
    return out.orderBy(F.desc("n"), *(key_text(k) for k in keys))


def shape(finalised: DataFrame, fn: str) -> DataFrame:
    """Round released values; a correlation gains its p-value from the rounded count."""
    if "value" not in finalised.columns:
        return finalised
    places = 4 if fn == "corr" else 2
    out = finalised.withColumn("value", F.round("value", places).cast("double"))
    if fn == "corr":
        first = [c for c in out.columns if c not in ("value", "n")]
        out = out.select(*first, "value",
                         F.round(pearson_p(F.col("value"), F.col("n")), 3).alias("p_value"), "n")
    return out


def check_columns(df: DataFrame, declared) -> DataFrame:
    """Refuse a released table carrying a column its contract does not name."""
    extra = set(df.columns) - set(declared)
    if extra:
        raise StudyError(f"released columns outside the contract: {sorted(extra)}")
    return df


def require_keys(df: DataFrame, keys) -> None:
    absent = set(keys) - set(df.columns)
    if absent:
        raise StudyError(f"cell table lacks its keys {sorted(absent)}")


def output_contract(spec: QuerySpec) -> dict[str, str]:
    """Disclosure class of every released column of a request."""
    out = {k: "cell_key" for k in spec.keys}
    if spec.measure.fn != "count":
        out["value"] = PROCEDURES[spec.measure.fn].value_class
    if spec.measure.fn == "corr":
        out["p_value"] = "p_value"
    return {**out, "n": "count"}


def status_of(vetted: DataFrame, policy: Policy) -> DataFrame:
    """One row: status, review decision, cells kept.  Nothing kept is a denial."""
    kept = F.coalesce(F.sum(F.when(fails(), 0).otherwise(1)), F.lit(0))
    lost = F.coalesce(F.bool_or(fails()), F.lit(False))
    status = (F.when(F.col("kept") == 0, "denied").when(F.col("lost"), "redacted")
              .otherwise("released"))
    review = (F.when(F.col("kept") == 0, "deny")
              .when(F.col("kept") > policy.max_cells, "human").otherwise("auto"))
    return (vetted.agg(kept.cast("bigint").alias("kept"), lost.alias("lost"))
            .select(status.alias("status"), review.alias("decision"), F.col("kept").alias("n_cells")))


def review_decision(found: DataFrame) -> DataFrame:
    """deny on an unresolved high finding, human on a medium one, else auto."""
    open_ = F.when(~F.col("suppressable"), F.col("severity"))
    rank = F.max(F.when(open_ == "high", 2).when(open_ == "medium", 1).otherwise(0))
    return found.agg(F.when(rank == 2, "deny").when(rank == 1, "human").otherwise("auto")
                     .alias("decision"))


@dataclass(frozen=True)
class Release:
    """What a request yields.

    The cells were judged and written when the request ran; the parts are
    DataFrames over that table.
    """

    spec: QuerySpec
    vetted: DataFrame      # internal: every cell with witnesses and failed rules
    released: DataFrame    # what leaves; empty unless it needs no review and is not denied
    findings: DataFrame    # rule, severity, suppressable, n_cells
    status: DataFrame      # one row: the cells' status, the review decision, cells kept
    outcome: DataFrame     # one row: released, redacted, review or denied, as enforced


def vet(cell_table: DataFrame, keys, policy: Policy, study: Study, value_class: str) -> DataFrame:
    require_keys(cell_table, keys)
    reasons = denial_reasons(set(cell_table.columns) - set(HELPERS), study)
    if reasons:
        raise StudyError(f"table denied: {reasons}")
    # written once: suppression, findings, status and the released table all read
    # these cells, none of them goes back to the rows
    judged = cut(judge(cell_table, keys, policy, study, value_class))
    return complementary(judged, keys, policy)


def kept_cells(vetted: DataFrame) -> Column:
    """Number of cells that pass, as a scalar subquery."""
    return vetted.agg(F.coalesce(F.sum(F.when(fails(), 0).otherwise(1)), F.lit(0))).scalar()


def granularity_finding(vetted: DataFrame, policy: Policy) -> DataFrame:
    """``too_granular`` when more cells pass than may leave without a person's review."""
    return (vetted.agg(F.coalesce(F.sum(F.when(fails(), 0).otherwise(1)), F.lit(0)).cast("bigint").alias("n_cells"))
            .where(F.col("n_cells") > policy.max_cells)
            .select(F.lit("too_granular").alias("rule"), F.lit(SEVERITY["too_granular"]).alias("severity"),
                    F.lit(False).alias("suppressable"), "n_cells"))


def outcome_of(status: DataFrame) -> DataFrame:
    """The status with the review decision enforced."""
    return status.select(F.when(F.col("decision") == "deny", "denied").when(F.col("decision") == "human", "review")
                         .otherwise(F.col("status")).alias("outcome"))


def release_cells(cell_table: DataFrame, spec: QuerySpec, policy: Policy, study: Study) -> Release:
    """Judge a request's cells and enforce the outcome.

    A table that carries a column which must never leave is denied whole: no cell
    is released and each reason is a finding that suppression cannot settle.
    """
    proc, keys = PROCEDURES[spec.measure.fn], spec.keys
    reasons = denial_reasons(set(cell_table.columns) - set(HELPERS), study)
    if reasons:
        vetted = cut(cell_table.withColumn("failed_rules", F.array(*(F.lit(r) for r in reasons))))
        counted = vetted.agg(F.count(F.lit(1)).alias("n_cells"))
        found = counted.select(F.explode(F.array(*(F.lit(r) for r in reasons))).alias("rule"), F.lit("high").alias("severity"),
                               F.lit(False).alias("suppressable"), "n_cells")
        status = counted.select(F.lit("denied").alias("status"), F.lit("deny").alias("decision"),
                                F.lit(0).cast("bigint").alias("n_cells"))
        return Release(spec, vetted, vetted.where(F.lit(False)).drop(*HELPERS, "failed_rules", *study.having_role("DI"),
                                                                     *study.free_text), found, status, outcome_of(status))
    vetted = vet(cell_table, keys, policy, study, proc.value_class)
    leaving = vetted.where(~fails() & (kept_cells(vetted) <= policy.max_cells))
    out = shape(finalise(leaving, keys, policy), spec.measure.fn)
    check_columns(out, output_contract(spec))
    status = status_of(vetted, policy)
    found = findings(vetted).unionByName(granularity_finding(vetted, policy))
    return Release(spec, vetted, out, found, status, outcome_of(status))


def release(ws: Workspace, spec: QuerySpec, policy: Policy | None = None) -> Release:
    """Run one request through the gateway.

    More passing cells than ``policy.max_cells`` need a person's review: nothing is
    released and the outcome is ``review``.
    """
    return release_cells(cells(ws, spec), spec, policy or Policy(), ws.study)


def published_marginals(marginal_table: DataFrame, study: Study, policy: Policy) -> DataFrame:
    """Marginals that may be shown: rounded at or above the threshold; below it
    a declared value keeps an empty count and an undeclared column's value goes.
    Values outside a declared domain go always."""
    spark = marginal_table.sparkSession
    rows = [(d, str(v).lower() if isinstance(v, bool) else str(v))
            for d, values in study.domains.items() for v in values]
    declared = spark.createDataFrame(rows or [("", "")], "dim string, value string")
    names = [d for d in study.domains]
    has_domain = F.col("dim").isin(names) if names else F.lit(False)
    enough = F.col("n_persons") >= policy.min_persons
    keep = marginal_table.where(~has_domain & enough & F.col("value").isNotNull()).unionByName(
        marginal_table.join(declared, ["dim", "value"], "left_semi"))
    return keep.select("view", "dim", "value",
                       F.when(enough, rounded(F.col("n_persons"), policy.round_base)).alias("n"))
