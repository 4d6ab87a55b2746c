"""Cell rules as one array column, and comparisons between rule sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..study import Policy, Study
from .cells import COUNT_COLUMNS
from .measures import ratio

# What is done about each rule.
CELL_RULES = ("small_cell", "dominance", "influence", "nonfinite_value", "undeclared_cell_key")
SEVERITY = {**{r: "high" for r in CELL_RULES}, "secondary_suppression": "low",
            "too_granular": "medium"}


def not_finite(c: Column) -> Column:
    d = c.cast("double")
    return d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))


def small_cell(columns, policy: Policy) -> Column:
    return reduce(lambda a, b: a | b,
                  (F.col(c).isNull() | (F.col(c) < policy.min_persons) for c in columns))


def unresolved_or_above(c: Column, bound: float) -> Column:
    return c.isNull() | F.isnan(c) | (c > F.lit(bound))


def undeclared(c: Column, domain) -> Column:
    return c.isNotNull() & ~c.isin(list(domain))


def rule_columns(columns, keys, policy: Policy, study: Study,
                 value_class: str = "magnitude") -> dict[str, Column]:
    """Every cell rule that applies to a table with these columns."""
    out: dict[str, Column] = {}
    counts = [c for c in columns if c in COUNT_COLUMNS]
    if counts:
        out["small_cell"] = small_cell(counts, policy)
    if "dominance" in columns:
        out["dominance"] = unresolved_or_above(F.col("dominance"), policy.dominance_for(value_class))
    if "influence" in columns:
        out["influence"] = unresolved_or_above(F.col("influence"), policy.influence)
    payload = [c for c in ("value", "p_value") if c in columns]
    if counts and payload:
        out["nonfinite_value"] = reduce(lambda a, b: a | b, (not_finite(F.col(c)) for c in payload))
    declared = [undeclared(F.col(k), study.domain(k)) for k in keys if study.domain(k) is not None]
    if declared:
        out["undeclared_cell_key"] = reduce(lambda a, b: a | b, declared)
    return out


def judge(cell_table: DataFrame, keys, policy: Policy, study: Study,
          value_class: str = "magnitude") -> DataFrame:
    """Add ``failed_rules``: the names of the rules a cell fails."""
    rules = rule_columns(cell_table.columns, keys, policy, study, value_class)
    names = F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(r)) for r, c in rules.items()))
    return cell_table.withColumn("failed_rules", F.array_compact(names))


def fails() -> Column:
    return F.size("failed_rules") > 0


def findings(judged: DataFrame) -> DataFrame:
    """One row per rule that fired: rule, severity, suppressable, n_cells."""
    hit = judged.select(F.explode("failed_rules").alias("rule"))
    severity = F.coalesce(*(F.when(F.col("rule") == r, F.lit(s)) for r, s in SEVERITY.items()),
                          F.lit("high"))
    return (hit.groupBy("rule").agg(F.count(F.lit(1)).alias("n_cells"))
            .select("rule", severity.alias("severity"), F.lit(True).alias("suppressable"), "n_cells"))


def denial_reasons(columns, study: Study, has_counts: bool | None = None) -> list[str]:
    """Schema-level reasons to withhold a whole table."""
    names = set(columns)
    counts = bool(names & set(COUNT_COLUMNS)) if has_counts is None else has_counts
    out = []
    if names & study.having_role("DI"):
        out.append("identifier_egress")
    if (names & (study.having_role("S") - study.having_role("DI"))) and not counts:
        out.append("raw_sensitive")
    if names & study.free_text:
        out.append("free_text_egress")
    return out


# -- rule sets over per-person contributions ---------------------------------------

def top_two(contrib: DataFrame, keys, c: str = "contribution") -> DataFrame:
    """Per cell: persons, total, largest and second largest contribution.

    The two largest come from a ranking whose limit Spark applies before the
    shuffle, so a cell that holds most persons sends two rows per task.  Contributions
    that a sweep has added up to cells hold them (``two``).
    """
    keys = list(keys)
    if c + "_two" in contrib.columns:
        place = lambda i: F.get(c + "_two", F.lit(i))
        return contrib.select(*keys, F.col("_persons").alias("persons"), F.col(c + "_total").alias("total"),
                              place(0).alias("largest"), place(1).alias("second"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(c)))
    best = (contrib.select(*keys, c).withColumn("_r", place).where(F.col("_r") <= 2).groupBy(*keys).agg(
        F.max(F.when(F.col("_r") == 1, F.col(c))).alias("largest"),
        F.max(F.when(F.col("_r") == 2, F.col(c))).alias("second")))
    total = contrib.groupBy(*keys).agg(F.count(F.lit(1)).alias("persons"), F.sum(c).alias("total"))
    right = best.select(*(F.col(k).alias("b_" + k) for k in keys), "largest", "second")
    joined = (total.join(right, [F.col(k).eqNullSafe(F.col("b_" + k)) for k in keys]) if keys
              else total.withColumn("_b", best.select(F.struct("largest", "second")).scalar())
              .select("*", "_b.*"))
    return joined.select(*keys, "persons", "total", "largest", "second")


def external_rules(top: DataFrame, threshold: int = 10, p: float = 0.1, k: float = 0.9) -> DataFrame:
    """Threshold, p%- and NK-rule verdicts on a table from :func:`top_two`."""
    second = F.coalesce(F.col("second"), F.lit(0)).cast("double")
    total, largest = F.col("total").cast("double"), F.col("largest").cast("double")
    rules = {
        "threshold": F.col("persons") < threshold,
        "p-ratio": (total - largest - second) < F.lit(p) * largest,
        "nk-rule": (largest + second) >= F.lit(k) * total,
    }
    names = F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(r)) for r, c in rules.items()))
    return top.withColumn("failed_rules", F.array_compact(names))


def key_text(c: str) -> Column:
    """A key as text for ordering; a missing key is empty."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def cell_text(keys) -> Column:
    return F.concat_ws("|", *(key_text(k) for k in keys)) if keys else F.lit("total")


# Fixed value: what a rule name from outside looks like.
RULE_NAME = "^[a-z][a-z0-9_-]{0,39}$"


def safe_rule_name(raw: Column) -> Column:
    """A rule name from outside, or ``unnamed`` unless it looks like one."""
    name = F.lower(F.trim(raw))
    return F.when(name.rlike(RULE_NAME), name).otherwise(F.lit("unnamed"))


def apply_verdicts(cell_table: DataFrame, keys, verdicts: DataFrame) -> DataFrame:
    """Join outside verdicts to cells.

    ``verdicts`` has ``rule`` (``release`` or rule names separated by ``;``) and
    either the key columns, matched null-safely, or ``cell``, the key text.  A text
    that stands for several cells (a missing key beside an empty one) names none of
    them.  A cell without a verdict is suppressed as ``checker_incomplete``, which
    denies the table.
    """
    if keys and set(keys) <= set(verdicts.columns):
        answer = verdicts.select(*(F.col(k).alias(f"_v{i}") for i, k in enumerate(keys)), F.col("rule").alias("_rule"))
        out = cell_table.join(answer, [F.col(k).eqNullSafe(F.col(f"_v{i}")) for i, k in enumerate(keys)], "left").drop(
            *(f"_v{i}" for i in range(len(keys))))
    else:
        texts = cell_table.withColumn("_key", cell_text(keys))
        plain = texts.groupBy("_key").agg(F.count(F.lit(1)).alias("_same")).where("_same = 1").select("_key")
        answer = verdicts.select(F.col("cell").alias("_key"), F.col("rule").alias("_rule")).join(plain, "_key", "left_semi")
        out = texts.join(answer, "_key", "left").drop("_key")
    named = F.transform(F.filter(F.split("_rule", ";"), lambda r: F.length(F.trim(r)) > 0),
                        safe_rule_name)
    failed = (F.when(F.col("_rule").isNull(), F.array(F.lit("checker_incomplete")))
              .when(F.col("_rule") == "release", F.array().cast("array<string>"))
              .otherwise(named))
    return out.withColumn("failed_rules", failed).drop("_rule")


def verdict_status(judged: DataFrame) -> DataFrame:
    """denied when a cell got no verdict or nothing is left, else redacted or released."""
    missing = F.array_contains("failed_rules", "checker_incomplete")
    kept = F.sum(F.when(fails(), 0).otherwise(1))
    status = (F.when(F.coalesce(F.bool_or(missing), F.lit(True)) | (kept == 0), F.lit("denied"))
              .when(F.bool_or(fails()), F.lit("redacted")).otherwise(F.lit("released")))
    return judged.agg(status.alias("status"))


def merge_rule_sets(first: DataFrame, second: DataFrame, keys) -> DataFrame:
    """Suppress a cell when either rule set does; rule names are united."""
    other = second.select(*(F.col(k).alias("o_" + k) for k in keys),
                          F.col("failed_rules").alias("o_failed"))
    joined = first.join(other, [F.col(k).eqNullSafe(F.col("o_" + k)) for k in keys], "left")
    absent = F.array(F.lit("checker_incomplete"))
    both = F.array_union("failed_rules", F.coalesce("o_failed", absent))
    return joined.select(*first.columns[:-1], F.array_sort(both).alias("failed_rules"))


def compare_rule_sets(first: DataFrame, second: DataFrame, keys) -> DataFrame:
    """Cells by agreement class of two rule sets over the same cells."""
    a = first.select(*keys, fails().alias("a"))
    b = second.select(*(F.col(k).alias("o_" + k) for k in keys), fails().alias("b"))
    both = a.join(b, [F.col(k).eqNullSafe(F.col("o_" + k)) for k in keys], "full")
    x, y = F.coalesce("a", F.lit(True)), F.coalesce("b", F.lit(True))
    kind = (F.when(x & y, "agree_suppress").when(x, "first_stricter")
            .when(y, "second_stricter").otherwise("agree_release"))
    return both.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n_cells"))


def pair_share(top: DataFrame) -> Column:
    return ratio(F.col("largest") + F.coalesce("second", F.lit(0)), F.col("total"))
