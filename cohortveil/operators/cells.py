"""Safe aggregates: cells with row counts, person counts and safety witnesses.

One two-stage aggregate serves value, person count and witness together:
rows → (cell, person) → cell.  Both stages combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..specs import Filter, Measure, QuerySpec
from ..study import PERSON, StudyError
from .lattice import by_person, grouping_text, key_sets, sweep_persons
from .measures import INFINITY, PROCEDURES, dominance, pearson, power
from .predicates import conjunction
from .views import Workspace

COUNT_COLUMNS = ("n", "n_persons")
HELPERS = ("n_persons", "dominance", "influence")


def contributions(ws: Workspace, spec: QuerySpec) -> DataFrame:
    """What each person adds to each cell (internal; never released)."""
    proc = PROCEDURES[spec.measure.fn]
    if proc.witness == "influence":
        return _deviations(ws, spec).drop("_ux", "_uy")
    pp = ws.per_person(spec.view, spec.keys, spec.filters, proc.guards(spec.measure),
                       lambda column: proc.parts(spec.measure, column))
    if proc.witness != "dominance":
        return pp
    return pp.where(F.col("_c").isNotNull()).withColumnRenamed("_c", "contribution")


def cells(ws: Workspace, spec: QuerySpec) -> DataFrame:
    """keys…, value (absent for a count), n, n_persons, dominance or influence."""
    spec.check(ws.study)
    proc, m, keys = PROCEDURES[spec.measure.fn], spec.measure, list(spec.keys)
    if proc.witness == "influence":
        return _correlation_cells(_deviations(ws, spec), keys)
    pp = ws.per_person(spec.view, keys, spec.filters, proc.guards(m),
                       lambda column: proc.parts(m, column))
    size = [F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("n_persons")]
    if proc.witness is None:
        return pp.groupBy(*keys).agg(*size)
    if proc.witness == "dominance":
        out = pp.groupBy(*keys).agg(*size, *share_terms("_c"))
        value = F.col("_c_total")
        if proc.averaged:
            value = value / F.when(F.col("n") > 0, F.col("n"))
        return out.select(*keys, value.alias("value"), "n", "n_persons", share("_c").alias("dominance"))
    raise StudyError(f"no cells for witness {proc.witness!r}")


def _with_cell(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the struct ``_t`` of their cell's totals."""
    if not keys:
        # one row of totals: read as a scalar subquery, not joined
        return rows.withColumn("_t", totals.select(F.struct(*totals.columns)).scalar())
    names = [c for c in totals.columns if c not in keys]
    other = totals.select(*(F.col(k).alias("t_" + k) for k in keys), F.struct(*names).alias("_t"))
    return rows.join(other, [F.col(k).eqNullSafe(F.col("t_" + k)) for k in keys]).drop(*("t_" + k for k in keys))


def _deviations(ws: Workspace, spec: QuerySpec) -> DataFrame:
    """Per person and cell, sums of deviations from the cell's own means (``_ux``, ``_uy``).

    Rows are read into states of count, means and centred moments.  The means of a cell
    come from those states, so values that lie far from zero, or from those of other
    cells, lose nothing, and rows are not read again for a centre.
    """
    proc, m, keys = PROCEDURES[spec.measure.fn], spec.measure, list(spec.keys)
    states, several = ws.leaves(spec.view, keys, spec.filters, proc.guards(m), lambda column: proc.states(m, column))
    size = F.sum("_n")
    means = states.groupBy(*keys).agg((F.sum(F.col("_n") * F.col("_mx")) / size).alias("ux"),
                                      (F.sum(F.col("_n") * F.col("_my")) / size).alias("uy"))
    rows = _with_cell(states, means, keys).withColumns({"_ux": F.col("_t.ux"), "_uy": F.col("_t.uy")})
    parts = {"_n": F.col("_n"), **proc.about(F.col("_ux"), F.col("_uy"))}
    if not several:
        return rows.select(*keys, PERSON, "_ux", "_uy", *(c.alias(k) for k, c in parts.items()))
    return rows.groupBy(*keys, PERSON, "_ux", "_uy").agg(*(F.sum(c).alias(k) for k, c in parts.items()))


def share_terms(c: str) -> list[Column]:
    """Aggregates of one per-person contribution column needed for its share."""
    return [F.sum(c).alias(f"{c}_total"), F.max(F.abs(c)).alias(f"{c}_largest"),
            F.sum(F.abs(c)).alias(f"{c}_magnitude")]


def share(c: str) -> Column:
    return dominance(F.col(f"{c}_largest"), F.col(f"{c}_magnitude"), F.col(f"{c}_total"))


def _correlation_cells(pp: DataFrame, keys: list[str]) -> DataFrame:
    """r and the largest change of r when one person is left out.

    Every person row meets the totals of its cell once; both the value and the
    witness come out of that one aggregate.
    """
    names = ["_n", "_x", "_y", "_xx", "_yy", "_xy"]
    sums = pp.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in names), F.max("_ux").alias("_ux"), F.max("_uy").alias("_uy"))
    noise = lambda of: ((of("_xx"), of("_ux")), (of("_yy"), of("_uy")))
    # r of the whole cell is one per cell, not one per person
    sums = sums.withColumn("r", pearson(*(F.col(c) for c in names), noise(F.col)))
    t = lambda c: F.col("_t." + c)
    rest = pearson(*(t(c) - F.col(c) for c in names), noise(t))
    moved = F.when(t("_n") - F.col("_n") >= 3, F.nanvl(F.abs(t("r") - rest), F.lit(INFINITY)))
    out = _with_cell(pp, sums, keys).groupBy(*keys).agg(
        F.max(F.coalesce(moved, F.lit(INFINITY))).alias("influence"), F.count(F.lit(1)).alias("n_persons"), F.any_value("_t").alias("_t"))
    inside = F.when(t("r") > 1, 1.0).when(t("r") < -1, -1.0).otherwise(t("r"))
    return out.select(*keys, inside.alias("value"), F.coalesce(t("_n"), F.lit(0)).alias("n"), "n_persons",
                      F.coalesce("influence", F.lit(INFINITY)).alias("influence"))


def person_counts(ws: Workspace, spec: QuerySpec) -> DataFrame:
    """Distinct persons per cell over exactly the rows the measure reads."""
    guards = PROCEDURES[spec.measure.fn].guards(spec.measure)
    pp = ws.per_person(spec.view, spec.keys, spec.filters, guards)
    return pp.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n_persons"))


def largest_cells(cell_table: DataFrame, keys, k: int) -> DataFrame:
    """The k cells with most rows, ties by key."""
    return cell_table.orderBy(F.desc("n"), *keys).limit(k)


def moment_cells(ws: Workspace, view: str, column: str, keys, filters=(), degrees=(1, 2)) -> DataFrame:
    """Several power sums of one column with one witness each, in one pass.

    Columns: keys…, n, n_persons, s1…, dominance1….
    """
    names = {k: f"_c{k}" for k in degrees}
    pp = ws.per_person(view, keys, tuple(filters), (column,),
                       lambda col: {names[k]: power(col(column), k) for k in degrees})
    terms = [t for c in names.values() for t in share_terms(c)]
    out = pp.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_persons"), *terms)
    return out.select(*keys, "n", "n_persons",
                      *(F.col(f"{c}_total").alias(f"s{k}") for k, c in names.items()),
                      *(share(c).alias(f"dominance{k}") for k, c in names.items()))


def cohort_size(ws: Workspace, view: str, filters: tuple[Filter, ...]) -> DataFrame:
    """Distinct persons selected by a filter list."""
    return ws.per_person(view, (), filters).agg(F.count(F.lit(1)).alias("n_persons"))


# -- marginals -----------------------------------------------------------------

def combination_persons(ws: Workspace, view: str, dims=None) -> DataFrame:
    """Distinct (dimension values, person) rows of a view: what any filter over
    those dimensions can tell apart."""
    v = ws.study.view(view)
    dims = sorted(v.filter_kinds()) if dims is None else list(dims)
    return ws.per_person(view, dims).drop("_n")


def long_values(df: DataFrame, view: str, kinds: dict[str, str], keep=()) -> DataFrame:
    """Unpivot dimensions to (view, dim, kind, value-as-text)."""
    rows = F.array(*(F.struct(F.lit(d).alias("dim"), F.lit(k).alias("kind"),
                              F.col(d).cast("string").alias("value"))
                     for d, k in sorted(kinds.items())))
    return df.select(F.lit(view).alias("view"), *keep, F.inline(rows))


def marginals(ws: Workspace, views=None) -> DataFrame:
    """Distinct persons behind every value of every filterable dimension.

    view, dim, kind, value, n_persons.  Rows collapse to distinct dimension
    combinations per person before they are unpivoted; the unpivoted rows name
    their dimension by number until they are counted.  They stay with their person, so
    what is shuffled once they are unpivoted is one row per value and task.
    """
    out = None
    for name in sorted(views or ws.study.views):
        kinds = sorted(ws.study.view(name).filter_kinds().items())
        rows = by_person(combination_persons(ws, name, [d for d, _ in kinds]), len(kinds))
        values = F.array(*(F.col(d).cast("string") for d, _ in kinds))
        counted = (rows.select(PERSON, F.posexplode(values).alias("_d", "value")).distinct()
                   .groupBy("_d", "value").agg(F.count(F.lit(1)).alias("n_persons")))
        label = lambda i: F.element_at(F.array(*(F.lit(k[i]) for k in kinds)), F.col("_d") + 1)
        part = counted.select(F.lit(name).alias("view"), label(0).alias("dim"), label(1).alias("kind"),
                              "value", "n_persons")
        out = part if out is None else out.unionByName(part)
    return out


# -- sweeps over every group-by ---------------------------------------------------

def swept_cells(persons: DataFrame, dims) -> DataFrame:
    """Cells of every group-by from :func:`sweep_persons`.

    With counted hits: ``k`` of them, by ``k_persons``.
    """
    names = [c.removesuffix("_total") for c in persons.columns if c.startswith("_c") and c.endswith("_total")]
    hits = [F.col("_k").alias("k"), F.col("_k_persons").alias("k_persons")] if "_k" in persons.columns else []
    return persons.select("grouping", *sorted(dims), F.col("_n").alias("n"), F.col("_persons").alias("n_persons"),
                          *(F.col(f"{c}_total").alias(f"s{c[2:]}") for c in names),
                          *(share(c).alias(f"dominance{c[2:]}") for c in names), *hits)


def sweep_cells(ws: Workspace, view: str, column: str, dims=None, widest: int = 3,
                filters=(), degrees=(1, 2), hits: str | None = None) -> DataFrame:
    """All group-bys of a measure in one job: grouping (text), dims… (NULL outside
    the set), n, n_persons, s1…, dominance1…."""
    dims = sorted(dims or ws.study.view(view).dims)
    persons = sweep_persons(ws, view, column, dims, widest, filters, degrees, hits, named=False)
    # a set's name is spelled out once per cell, not once per person
    return swept_cells(persons, dims).withColumn("grouping", grouping_text(F.col("grouping"), dims))


def measure_configs(ws: Workspace) -> list[dict]:
    """Every admissible (view, measure, group-by width) of the study."""
    out = []
    for name in sorted(ws.study.views):
        view = ws.study.view(name)
        for fn in sorted(PROCEDURES):
            out += [{"view": name, **c} for c in PROCEDURES[fn].configs(view)]
    return out


__all__ = ["Measure", "cells", "cohort_size", "contributions", "conjunction", "grouping_text", "key_sets", "largest_cells",
           "marginals", "moment_cells", "person_counts", "sweep_cells", "sweep_persons"]
