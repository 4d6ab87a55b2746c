"""Checks of released tables against the rows they came from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..specs import QuerySpec, cohort_predicates
from ..study import PERSON, Policy, Study
from .cells import COUNT_COLUMNS
from .lineage import close_pairs
from .predicates import conjunction, not_null
from .rules import not_finite, undeclared
from .views import Workspace


def _attach(released: DataFrame, truth: DataFrame, keys) -> DataFrame:
    other = truth.select(*(F.col(k).alias("t_" + k) for k in keys),
                         *(F.col(c).alias("t_" + c) for c in truth.columns if c not in keys))
    return released.join(other, [F.col(k).eqNullSafe(F.col("t_" + k)) for k in keys], "left")


def _rows(ws: Workspace, spec: QuerySpec) -> DataFrame:
    """The person-level rows a request reads, straight from the view."""
    measured = [c for c in (spec.measure.column, spec.measure.x, spec.measure.y) if c]
    return ws.unit(spec.view).where(conjunction(spec.filters)).where(not_null(measured))


def undersized_cells(ws: Workspace, released: DataFrame, spec: QuerySpec, policy: Policy) -> DataFrame:
    """Released cells that describe fewer persons than the threshold: keys…, n_persons.

    Persons are counted anew from the rows, not by the code that released the table.
    """
    truth = _rows(ws, spec).groupBy(*spec.keys).agg(F.count_distinct(PERSON).alias("n_persons"))
    out = _attach(released, truth, list(spec.keys))
    persons = F.coalesce("t_n_persons", F.lit(0))
    return out.where(persons < policy.min_persons).select(*spec.keys, persons.alias("n_persons"))


def dominated_cells(ws: Workspace, released: DataFrame, spec: QuerySpec, policy: Policy) -> DataFrame:
    """Released cells one person dominates: keys…, dominance; recomputed from the rows."""
    per = (_rows(ws, spec).groupBy(*spec.keys, PERSON)
           .agg(F.sum(spec.measure.column).cast("double").alias("c")))
    size = per.groupBy(*spec.keys).agg(F.max(F.abs("c")).alias("top"), F.sum(F.abs("c")).alias("all"), F.abs(F.sum("c")).alias("net"))
    share = F.when((F.col("all") > 0) & (F.col("net") > 0), F.greatest(F.col("top") / F.col("all"), F.col("top") / F.col("net")))
    out = _attach(released, size.select(*spec.keys, share.alias("dominance")), list(spec.keys))
    found = F.coalesce("t_dominance", F.lit(float("inf")))
    return out.where(found > policy.dominance).select(*spec.keys, found.alias("dominance"))


def egress(columns, study: Study) -> list[str]:
    """Columns that may never leave, whatever their values."""
    names = set(columns)
    internal = {c for v in study.views.values() for c in (*v.internal_filters, *v.internal_measures)}
    out = []
    if names & study.having_role("DI"):
        out.append("identifier_egress")
    if names & internal:
        out.append("internal_variable_egress")
    if names & study.free_text:
        out.append("free_text_egress")
    if (names & (study.having_role("S") - study.having_role("DI"))) and not names & set(COUNT_COLUMNS):
        out.append("raw_sensitive")
    return out


def bad_values(released: DataFrame, keys, study: Study) -> DataFrame:
    """Released cells with a value that is no number or a key that is not declared: problem, n_cells."""
    checks = {c: not_finite(F.col(c)) for c in ("value", "p_value") if c in released.columns}
    checks |= {k: undeclared(F.col(k), study.domain(k)) for k in keys if study.domain(k) is not None}
    found = F.array_compact(F.array(*(F.when(bad, F.lit(c)) for c, bad in checks.items())))
    return released.select(F.explode(found).alias("problem")).groupBy("problem").agg(
        F.count(F.lit(1)).alias("n_cells"))


def cells_as_cohorts(released: DataFrame, view: str, keys, label: str, filters=()) -> DataFrame:
    """Each released cell as the cohort its keys select among the request's own filters.

    A cell whose key is missing is no cohort of predicates (a missing value
    satisfies none): it comes out as the cell with ``predicates`` NULL, to be
    looked at by a person, never silently dropped.
    """
    kind = "array<struct<column:string,op:string,values:array<string>>>"
    named = [F.struct(F.lit(k).alias("column"), F.lit("==").alias("op"), F.array(F.col(k).cast("string")).alias("values")) for k in keys]
    own = [F.struct(F.lit(c).alias("column"), F.lit(op).alias("op"), F.array(*(F.lit(v) for v in values)).alias("values"))
           for c, op, values in cohort_predicates(filters)]
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys), F.lit(True))
    text = F.concat_ws("|", F.lit(label), *(F.coalesce(F.col(k).cast("string"), F.lit("(missing)")) for k in keys))
    return released.select(text.alias("cohort_id"), F.lit(view).alias("view"),
                           F.when(whole, F.array(*named, *own).cast(kind)).alias("predicates"))


def composable_pairs(ws: Workspace, view: str, cell_cohorts: DataFrame, policy: Policy) -> DataFrame:
    """Pairs of released cells of one measure that differ over too few persons.

    All pairs are covered; only the close ones are ever listed.  Every released cell
    counts, however few persons it turns out to have.
    """
    known = cell_cohorts.where(F.col("predicates").isNotNull())
    return close_pairs(ws, view, known, policy.delta, 1)


def planted_checks(released: DataFrame, key: str, order) -> DataFrame:
    """Shape of a released table over an ordered key: monotone, argmax, ratio, spread.

    One row; the order is a declared list of levels.
    """
    place = F.coalesce(*(F.when(F.col(key).cast("string") == str(v), F.lit(i)) for i, v in enumerate(order)))
    rows = released.select(F.col(key).alias("k"), F.col("value").alias("v"), place.alias("i")).where("i is not null")
    after = rows.select((F.col("i") - 1).alias("i"), F.col("v").alias("next"))
    steps = rows.join(after, "i")
    rising = steps.agg(F.coalesce(F.bool_and(F.col("v") < F.col("next")), F.lit(False)).alias("m")).scalar()
    return rows.agg(F.max_by("k", "v").alias("argmax"), (F.max("v") / F.min("v")).alias("ratio"),
                    ((F.max("v") - F.min("v")) / F.avg("v")).alias("spread")).withColumn("monotone", rising)
