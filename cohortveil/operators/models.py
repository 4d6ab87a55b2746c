"""Generalised linear models fitted from vetted cells.

A model is planned as one aggregate over its terms.  Every planned table is
judged by the cell rules; a redacted required table denies the model.  The fit
sees only finalised cells.  Cells of many models share one table and are
fitted together: design columns are indicator positions, X'WX and X'Wz are
sums over cells, and only the small p×p systems reach Python, one per model.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tails import normal_sf, student_sf
from ..session import cut
from ..specs import Filter, GlmSpec
from ..study import Policy, Study, StudyError
from .cells import moment_cells
from .gateway import rounded
from .measures import ratio
from .rules import not_finite, rule_columns, unresolved_or_above
from .views import Workspace

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Canonical links, iteration limits and numeric guards.
LINKS = {"gaussian": "identity", "binomial": "logit", "poisson": "log"}
MAX_STEPS, TOLERANCE = 100, 1e-10
MU_FLOOR, ETA_CAP, PIVOT = 1e-10, 700.0, 1e-9


# -- planned tables ------------------------------------------------------------------

def gaussian_tables(ws: Workspace, view: str, response: str, terms, filters=(),
                    policy: Policy | None = None) -> DataFrame:
    """Terms, finalised mean, sum_sq and n, and which role each cell fails.

    ``fails_mean`` / ``fails_sum_sq`` say that the rules would withhold the cell
    from that table.
    """
    policy = policy or Policy()
    raw = moment_cells(ws, view, response, terms, filters)
    mean = ratio(F.col("s1"), F.col("n"))
    exact = F.round(F.col("s1") / F.col("n"), 2).cast("double")
    shared = _shared_rules(ws.study, terms, policy)
    return raw.select(
        *terms, exact.alias("mean"), F.round("s2", 2).cast("double").alias("sum_sq"),
        rounded(F.col("n"), policy.round_base).alias("n"), F.col("n").alias("raw_n"),
        mean.alias("raw_mean"), F.col("s2").cast("double").alias("raw_sum_sq"), F.col("n_persons").alias("raw_persons"),
        (shared | not_finite(mean)
         | unresolved_or_above(F.col("dominance1"), policy.dominance)).alias("fails_mean"),
        (shared | not_finite(F.col("s2"))
         | unresolved_or_above(F.col("dominance2"), policy.dominance_for("moment2"))).alias("fails_sum_sq"))


def _shared_rules(study: Study, terms, policy: Policy) -> Column:
    rules = rule_columns(["n", "n_persons"], terms, policy, study)
    return reduce(lambda a, b: a | b, rules.values())


def binomial_tables(ws: Workspace, view: str, response: str, terms, filters=(),
                    policy: Policy | None = None) -> DataFrame:
    """Trials n and successes k per cell; an absent success cell is k = 0."""
    policy = policy or Policy()
    pp = ws.per_person(view, terms, tuple(filters), (),
                       lambda c: {"_k": F.when(c(response), 1).otherwise(0)})
    raw = pp.groupBy(*terms).agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_persons"), F.sum("_k").alias("k"),
        F.sum(F.when(F.col("_k") > 0, 1).otherwise(0)).alias("k_persons"))
    shared = _shared_rules(ws.study, terms, policy)
    few = (F.col("k") > 0) & ((F.col("k") < policy.min_persons) | (F.col("k_persons") < policy.min_persons))
    return raw.select(*terms, rounded(F.col("k"), policy.round_base).alias("k"),
                      rounded(F.col("n"), policy.round_base).alias("n"),
                      F.col("k").alias("raw_k"), F.col("n").alias("raw_n"),
                      F.col("n_persons").alias("raw_persons"), F.col("k_persons").alias("raw_k_persons"),
                      shared.alias("fails_trials"), few.alias("fails_successes"))


def poisson_tables(ws: Workspace, view: str, response: str, terms, filters=(),
                   policy: Policy | None = None) -> DataFrame:
    """Total of a count response and n per cell."""
    policy = policy or Policy()
    raw = moment_cells(ws, view, response, terms, filters, degrees=(1,))
    fails = (_shared_rules(ws.study, terms, policy) | not_finite(F.col("s1"))
             | unresolved_or_above(F.col("dominance1"), policy.dominance))
    return raw.select(*terms, F.round("s1", 2).cast("double").alias("sum"),
                      rounded(F.col("n"), policy.round_base).alias("n"),
                      F.col("s1").cast("double").alias("raw_sum"), F.col("n").alias("raw_n"),
                      F.col("n_persons").alias("raw_persons"),
                      fails.alias("fails_sum"))


PLANS = {"gaussian": gaussian_tables, "binomial": binomial_tables, "poisson": poisson_tables}
REQUIRED = {"gaussian": ("fails_mean",), "binomial": ("fails_trials", "fails_successes"),
            "poisson": ("fails_sum",)}


# -- common form of cells: one row per model and cell --------------------------------------

def as_model_cells(table: DataFrame, model_id: str, family: str, terms, raw: bool = False) -> DataFrame:
    """model_id, family, cell, terms, levels, y, w, off, ss (gaussian only)."""
    p = "raw_" if raw else ""
    n = F.col(p + "n").cast("double")
    y, w, off, ss = {
        "gaussian": lambda: (F.col(p + "mean"), n, F.lit(0.0), F.col(p + "sum_sq")),
        "binomial": lambda: (ratio(F.col(p + "k"), n), n, F.lit(0.0), F.lit(None)),
        "poisson": lambda: (F.col(p + "sum"), F.lit(1.0), F.log(F.when(n > 0, n)), F.lit(None)),
    }[family]()
    levels = F.array(*(F.col(t).cast("string") for t in terms))
    return table.select(
        F.lit(model_id).alias("model_id"), F.lit(family).alias("family"),
        F.to_json(levels).alias("cell"), F.array(*(F.lit(t) for t in terms)).alias("terms"),
        levels.alias("levels"), y.cast("double").alias("y"), w.alias("w"), off.alias("off"),
        ss.cast("double").alias("ss"), n.alias("n"))


def level_positions(cells: DataFrame, study: Study) -> DataFrame:
    """Design column of every level: model_id, term, level, position, col.

    Levels follow the declared order, then their own; the first is the
    reference and has no column.  Column 0 is the intercept.
    """
    spark = cells.sparkSession
    declared = [(d, str(v).lower() if isinstance(v, bool) else str(v), i)
                for d, values in study.domains.items() for i, v in enumerate(values)]
    known = spark.createDataFrame(declared or [("", "", 0)], "term string, level string, place int")
    seen = (cells.select("model_id", F.posexplode("terms").alias("k", "term"), "levels")
            .select("model_id", "k", "term", F.get("levels", F.col("k")).alias("level")).distinct())
    order = [F.col("place").asc_nulls_last(), F.col("level").try_cast("bigint"), F.col("level")]
    placed = seen.join(known, ["term", "level"], "left").withColumn(
        "position", F.row_number().over(W.partitionBy("model_id", "term").orderBy(*order)))
    column = F.row_number().over(W.partitionBy("model_id", "reference").orderBy("k", "position"))
    return (placed.withColumn("reference", F.col("position") == 1)
            .withColumn("col", F.when(~F.col("reference"), column))
            .select("model_id", "k", "term", "level", "position", "col"))


def design(cells: DataFrame, positions: DataFrame) -> DataFrame:
    """Cells with ``idx``: the design columns that are one (intercept included)."""
    rows = (cells.select("model_id", "cell", F.posexplode("levels").alias("k", "level"))
            .join(positions.select("model_id", "k", "level", "col"), ["model_id", "k", "level"])
            .groupBy("model_id", "cell")
            .agg(F.array_sort(F.collect_list("col")).alias("on")))   # at most one per term
    return cells.join(rows, ["model_id", "cell"]).withColumn(
        "idx", F.concat(F.array(F.lit(0)), "on")).drop("on")


def preconditions(cells: DataFrame, positions: DataFrame) -> DataFrame:
    """Reasons a model cannot be estimated: model_id, problem.

    Aliased terms cannot occur on a full grid and are found by the solver
    otherwise.
    """
    counts = positions.groupBy("model_id", "term").agg(F.count(F.lit(1)).alias("levels"))
    single = counts.where("levels < 2").select(
        "model_id", F.concat(F.lit("single level: "), "term").alias("problem"))
    grid = counts.groupBy("model_id").agg(F.product("levels").alias("full"))
    size = cells.groupBy("model_id").agg(F.count(F.lit(1)).alias("k"),
                                         F.bool_or(F.col("y").isNull() | F.isnan("y")).alias("gap"))
    whole = size.join(grid, "model_id")
    holes = whole.where("k <> full").select("model_id", F.lit("incomplete grid").alias("problem"))
    gaps = whole.where("gap").select("model_id", F.lit("missing value").alias("problem"))
    margin = (cells.where(F.col("family") == "binomial")
              .select("model_id", F.posexplode("terms").alias("k", "term"), "levels", "y", "w")
              .groupBy("model_id", "term", F.get("levels", F.col("k")).alias("level"))
              .agg(F.sum(F.col("y") * F.col("w")).alias("hits"), F.sum("w").alias("all")))
    split = margin.where((F.round("hits") == 0) | (F.round("hits") >= F.round("all"))).select(
        "model_id", F.concat(F.lit("separated: "), "term").alias("problem")).distinct()
    return single.unionByName(holes).unionByName(gaps).unionByName(split)


# -- fitting -----------------------------------------------------------------------------

_SOLVED = ("model_id string, beta array<double>, cov array<double>, estimable boolean")


def _solve(entries: pd.DataFrame) -> pd.DataFrame:
    """One model's normal equations, given as (i, j, v); j = -1 holds X'Wz."""
    p = int(entries["i"].max()) + 1
    left, right = np.zeros((p, p)), np.zeros(p)
    rhs = entries["j"].to_numpy() < 0
    i, j, v = (entries[c].to_numpy() for c in ("i", "j", "v"))
    right[i[rhs]] = v[rhs]
    left[i[~rhs], j[~rhs]] = v[~rhs]
    model, scale = entries["model_id"].iloc[0], np.diag(left)
    usable = np.isfinite(left).all() and np.isfinite(right).all() and scale.min() > 0
    # aliased columns show as a vanishing eigenvalue of the scaled matrix
    if not usable or np.linalg.eigvalsh(left / np.sqrt(np.outer(scale, scale)))[0] < PIVOT:
        return pd.DataFrame([[model, None, None, False]], columns=["model_id", "beta", "cov", "estimable"])
    cov = np.linalg.inv(left)
    return pd.DataFrame([[model, (cov @ right).tolist(), cov.ravel().tolist(), True]],
                        columns=["model_id", "beta", "cov", "estimable"])


def _normal_equations(weighted: DataFrame) -> DataFrame:
    """Solve X'WX b = X'Wz per model; rows carry idx, ww and z.

    A cell touches at most (terms + 1)² entries, so the sums stay sparse.
    """
    one = weighted.select("model_id", F.explode("idx").alias("i"), "idx", "ww", "z")
    left = one.select("model_id", "i", F.explode("idx").alias("j"), F.col("ww").alias("v"))
    right = one.select("model_id", "i", F.lit(-1).alias("j"), (F.col("ww") * F.col("z")).alias("v"))
    sums = left.unionByName(right).groupBy("model_id", "i", "j").agg(F.sum("v").alias("v"))
    return sums.groupBy("model_id").applyInPandas(_solve, _SOLVED)


def _linear(beta: str = "beta") -> Column:
    return F.aggregate("idx", F.lit(0.0), lambda acc, i: acc + F.get(F.col(beta), i))


def _mean(eta: Column, family: Column) -> Column:
    logit = 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-ETA_CAP), F.least(eta, F.lit(ETA_CAP)))))
    clipped = F.greatest(F.lit(MU_FLOOR), F.least(logit, F.lit(1.0 - MU_FLOOR)))
    expo = F.greatest(F.exp(F.least(eta, F.lit(ETA_CAP))), F.lit(MU_FLOOR))
    return F.when(family == "binomial", clipped).when(family == "poisson", expo).otherwise(eta)


def fit(cells: DataFrame, study: Study, positions: DataFrame | None = None,
        families: set[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Fit every estimable model in a table of cells.

    Returns (designed cells with fitted values, solutions: model_id, beta, cov,
    estimable).  Models of all families advance together; a model that has
    converged leaves the loop with its solution.  ``positions`` is passed when
    the preconditions were already checked on these cells, ``families`` when
    they are known.
    """
    if positions is None:
        positions = cut(level_positions(cells, study))
        bad = preconditions(cells, positions).select("model_id").distinct()
        cells = cells.join(bad, "model_id", "left_anti")
    if families is None:
        families = {r["family"] for r in cells.select("family").distinct().collect()}   # three at most
    rows = design(cells, positions)
    if families - {"gaussian"}:
        rows = cut(rows)          # read once per step
    done = []
    if "gaussian" in families:
        gaussian = rows.where(F.col("family") == "gaussian").select(
            "model_id", "idx", F.col("w").alias("ww"), F.col("y").alias("z"))
        done.append(cut(_normal_equations(gaussian)))
    if families - {"gaussian"}:
        done += _reweighted(rows.where(F.col("family") != "gaussian"))
    if not done:
        raise StudyError("no model can be estimated")
    solved = reduce(DataFrame.unionByName, done)
    fitted = (rows.join(solved, "model_id").where("estimable")
              .withColumn("fitted", _mean(_linear() + F.col("off"), F.col("family"))))
    return fitted.drop("beta", "cov", "estimable"), solved


def _reweighted(base: DataFrame) -> list[DataFrame]:
    """Iteratively reweighted least squares; each step reads the last written state."""
    done, state = [], None
    for _ in range(MAX_STEPS):
        eta = F.col("off") if state is None else _linear() + F.col("off")
        now = base if state is None else base.join(state.select("model_id", "beta"), "model_id")
        now = now.withColumn("eta", eta).withColumn("mu", _mean(F.col("eta"), F.col("family")))
        slope = F.when(F.col("family") == "binomial", F.col("mu") * (1 - F.col("mu"))).otherwise(F.col("mu"))
        now = now.withColumn("slope", slope)
        new = _normal_equations(now.select(
            "model_id", "idx", (F.col("w") * F.col("slope")).alias("ww"),
            (F.col("eta") - F.col("off") + (F.col("y") - F.col("mu")) / F.col("slope")).alias("z")))
        if state is None:
            new = new.withColumn("settled", ~F.col("estimable"))
        else:
            gap = F.array_max(F.zip_with("beta", "old", lambda a, b: F.abs(a - b)))
            new = new.join(state.select("model_id", F.col("beta").alias("old")), "model_id").withColumn(
                "settled", F.coalesce(gap < TOLERANCE, F.lit(True))).drop("old")
        new = cut(new)
        done.append(new.where("settled").drop("settled"))
        state = new.where(~F.col("settled")).drop("settled")
        if state.isEmpty():
            return done
    # still moving: a row all the same, so that no model is lost without a word
    done.append(state.withColumn("estimable", F.lit(False)))
    return done


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.log(F.when(y > 0, y)))


def summaries(fitted: DataFrame, with_dispersion: bool = True) -> DataFrame:
    """One row per model: n, n_cells, params, df_resid, deviance, dispersion, r_squared."""
    y, mu, w, n, ss = (F.col(c) for c in ("y", "fitted", "w", "n", "ss"))
    deviance = (F.when(F.col("family") == "gaussian", w * (y - mu) * (y - mu))
                .when(F.col("family") == "binomial",
                      2 * w * (_xlogy(y, ratio(y, mu)) + _xlogy(1 - y, ratio(1 - y, 1 - mu))))
                .otherwise(2 * (_xlogy(y, ratio(y, mu)) - (y - mu))))
    out = fitted.groupBy("model_id", "family").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_cells"),
        (F.max(F.array_max("idx")) + 1).alias("params"), F.sum(deviance).alias("lack"),
        F.sum(F.greatest(F.lit(0.0), ss - n * y * y)).alias("within"),
        F.sum("ss").alias("ss"), F.sum(n * y).alias("ny"))
    gaussian = F.col("family") == "gaussian"
    df = F.when(gaussian, F.col("n") - F.col("params")).otherwise(F.col("n_cells") - F.col("params"))
    total = F.col("lack") + F.when(gaussian, F.col("within")).otherwise(0.0)
    tss = F.col("ss") - F.col("ny") * F.col("ny") / F.col("n")
    base = out.select(
        "model_id", "family", F.col("n").cast("bigint").alias("n"), "n_cells", "params",
        df.cast("double").alias("df_resid"), total.alias("deviance"),
        F.when(gaussian, ratio(total, F.when(df > 0, df))).otherwise(1.0).alias("dispersion"),
        F.when(gaussian & (tss > 0), 1 - ratio(total, F.when(tss > 0, tss))).alias("r_squared"))
    return base if with_dispersion else base.withColumn("dispersion", F.lit(None).cast("double"))


def coefficients(positions: DataFrame, solved: DataFrame, summary: DataFrame) -> DataFrame:
    """model_id, term, level, estimate, std_error, statistic, p_value (rounded)."""
    names = positions.where(F.col("col").isNotNull()).select("model_id", "term", "level", "col").unionByName(
        positions.select("model_id").distinct().select(
            "model_id", F.lit("(intercept)").alias("term"), F.lit("").alias("level"), F.lit(0).alias("col")))
    p = F.size("beta")
    se = F.sqrt(F.col("dispersion") * F.get("cov", F.col("col") * p + F.col("col")))
    b = F.get("beta", F.col("col"))
    rows = (names.join(solved.where("estimable"), "model_id").join(
        summary.select("model_id", "family", "dispersion", "df_resid"), "model_id")
        .select("model_id", "family", "df_resid", "term", "level", b.alias("b"), se.alias("se"))
        .withColumn("stat", ratio(F.col("b"), F.col("se"))))
    p_value = F.when(F.col("family") == "gaussian", 2 * student_sf(F.abs("stat"), "df_resid")).otherwise(
        2 * normal_sf(F.abs("stat")))
    return rows.select("model_id", "term", "level", F.round("b", 4).alias("estimate"),
                       F.round("se", 4).alias("std_error"), F.round("stat", 4).alias("statistic"),
                       F.round(F.when(F.col("stat").isNotNull(), p_value), 3).alias("p_value"))


# -- one request ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    """status: released, review or denied, with reasons; tables are None unless released."""

    status: str
    reasons: tuple[str, ...]
    coefficients: DataFrame | None = None
    summary: DataFrame | None = None
    cells: DataFrame | None = None


def release_model(ws: Workspace, spec: GlmSpec, policy: Policy | None = None) -> Model:
    """Plan, gate and fit one model request."""
    policy = policy or Policy()
    spec.check(ws.study)
    terms = list(spec.terms)
    table = cut(PLANS[spec.family](ws, spec.view, spec.response, terms, spec.filters, policy))
    roles = [c for c in table.columns if c.startswith("fails_")]
    verdict = table.agg(F.count(F.lit(1)).alias("k"),
                        *(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in roles)).first()
    if verdict["k"] == 0 or any(verdict[r] for r in REQUIRED[spec.family]):
        return Model("denied", ("nothing released",))
    if verdict["k"] > policy.max_cells:
        return Model("review", ("too_granular",))
    return fit_vetted(table, spec, ws.study, spec.family == "gaussian" and verdict["fails_sum_sq"])


def fit_vetted(table: DataFrame, spec: GlmSpec, study: Study, partial: bool) -> Model:
    """Fit from a planned table that passed; ``partial`` leaves out the sums of squares."""
    released = table.select(*[c for c in table.columns if not c.startswith(("fails_", "raw_"))])
    return fit_released(released.drop("sum_sq") if partial else released, spec, study)


def fit_released(released: DataFrame, spec: GlmSpec, study: Study) -> Model:
    """Fit from a released cell table alone (also the way to reproduce a fit)."""
    partial = spec.family == "gaussian" and "sum_sq" not in released.columns
    table = released.withColumn("sum_sq", F.lit(None).cast("double")) if partial else released
    cells = as_model_cells(table, spec.model_key(), spec.family, spec.terms)
    positions = cut(level_positions(cells, study))
    problems = preconditions(cells, positions).collect()   # a few per term of one model
    if problems:
        return Model("denied", tuple(sorted(r["problem"] for r in problems)))
    fitted, solved = fit(cells, study, positions, {spec.family})
    if solved.where("estimable").isEmpty():
        return Model("denied", ("terms are aliased or the fit did not converge",))
    summary = summaries(fitted, not partial)
    coefs = coefficients(positions, solved, summary)
    if partial:
        coefs = coefs.select("model_id", "term", "level", "estimate")
        summary = summary.select("model_id", "family", "n", "n_cells", "params", "df_resid",
                                 F.lit(False).alias("dispersion_released"))
    else:
        summary = summary.drop("dispersion").withColumns(
            {c: F.round(c, 4) for c in ("df_resid", "deviance", "r_squared")})
    summary = summary.withColumn("link", F.lit(LINKS[spec.family])).withColumn(
        "response", F.lit(spec.response))
    return Model("released", (), coefs, summary, released)


def successes_filter(spec: GlmSpec) -> Filter:
    """The extra predicate of a binomial model's second cohort."""
    return Filter(spec.response, "==", True)


# -- sweeps over many models ----------------------------------------------------------------

def lattice_models(sweep: DataFrame, dims, study: Study, policy: Policy, response: str, family: str) -> DataFrame:
    """Cells of every releasable model over the group-bys of a sweep, finalised and raw.

    One model per grouping set that does not hold the response and whose cells all pass the
    rules of the family's required tables: ``model_id`` is family:response:grouping:raw
    or …:released.  What makes a model inestimable is left to the fit.
    """
    dims = sorted(dims)
    terms = F.split("grouping", "\\+")
    inside = sweep.where((F.col("grouping") != "") & ~F.array_contains(terms, response))
    shared = _shared_rules(study, dims, policy)
    n, k = F.col("n"), F.col("k") if family == "binomial" else None
    if family == "binomial":
        few = (k > 0) & ((k < policy.min_persons) | (F.col("k_persons") < policy.min_persons))
        bad = shared | few
    else:
        bad = shared | not_finite(F.col("s1")) | unresolved_or_above(F.col("dominance1"), policy.dominance)
    lost = inside.groupBy("grouping").agg(F.bool_or(bad).alias("bad")).where("bad").select("grouping")
    kept = inside.join(lost, "grouping", "left_anti")
    used = F.array(*(F.struct(F.lit(d).alias("d"), F.col(d).cast("string").alias("v")) for d in dims))
    levels = F.transform(F.filter(used, lambda x: F.array_contains(terms, x["d"])), lambda x: x["v"])
    count = lambda c: rounded(c, policy.round_base)
    forms = {
        "gaussian": {"released": (F.round(F.col("s1") / n, 2), count(n)), "raw": (ratio(F.col("s1"), n), n)},
        "poisson": {"released": (F.round("s1", 2), count(n)), "raw": (F.col("s1"), n)},
        "binomial": {"released": (ratio(count(k), count(n)), count(n)), "raw": (ratio(k, n), n)} if family == "binomial" else {},
    }[family]
    sides = []
    for side, (y, size) in forms.items():
        weight = F.lit(1.0) if family == "poisson" else size.cast("double")
        offset = F.log(F.when(size > 0, size.cast("double"))) if family == "poisson" else F.lit(0.0)
        sides.append(F.struct(F.lit(side).alias("side"), y.cast("double").alias("y"), weight.alias("w"), offset.alias("off"),
                              size.cast("double").alias("n")))
    rows = kept.select("grouping", terms.alias("terms"), levels.alias("levels"), F.inline(F.array(*sides)))
    return rows.select(
        F.concat_ws(":", F.lit(family), F.lit(response), "grouping", "side").alias("model_id"), F.lit(family).alias("family"),
        F.to_json("levels").alias("cell"), "terms", "levels", "y", "w", "off", F.lit(None).cast("double").alias("ss"), "n")


def outcome_of_groupings(sweep: DataFrame, dims, policy: Policy) -> DataFrame:
    """What a gaussian model over each group-by of a sweep would release.

    grouping, outcome: complete, without_dispersion or denied.  A model needs
    every mean cell, two levels per term and a full grid.
    """
    small = (F.col("n_persons") < policy.min_persons) | (F.col("n") < policy.min_persons)
    mean = small | unresolved_or_above(F.col("dominance1"), policy.dominance)
    square = small | unresolved_or_above(F.col("dominance2"), policy.dominance_for("moment2"))
    used = F.array(*(F.struct(F.lit(d).alias("d"), F.col(d).cast("string").alias("v")) for d in dims))
    widths = (sweep.where(F.col("grouping") != "")
              .select("grouping", F.explode(F.filter(used, lambda x: F.array_contains(
                  F.split("grouping", "\\+"), x["d"]))).alias("x"))
              .distinct().groupBy("grouping", "x.d").agg(F.count(F.lit(1)).alias("levels"))
              .groupBy("grouping").agg(F.product("levels").alias("full"), F.min("levels").alias("least")))
    seen = sweep.where(F.col("grouping") != "").groupBy("grouping").agg(
        F.count(F.lit(1)).alias("k"), F.bool_or(mean).alias("no_mean"), F.bool_or(square).alias("no_square"))
    outcome = (F.when(F.col("no_mean") | (F.col("least") < 2) | (F.col("k") != F.col("full")), "denied")
               .when(F.col("no_square"), "without_dispersion").otherwise("complete"))
    return seen.join(widths, "grouping").select("grouping", outcome.alias("outcome"))


def sensitivity(sweep: DataFrame, policy: Policy) -> DataFrame:
    """Share of swept cells passing the bound on the linear and squared scale."""
    big = sweep.where(F.col("n_persons") >= policy.min_persons)
    finite = big.where((F.col("dominance1") < float("inf")) & (F.col("dominance2") < float("inf")))
    lin, sq = F.col("dominance1") <= policy.dominance, F.col("dominance2") <= policy.dominance
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return finite.agg(F.count(F.lit(1)).alias("cells"), count(lin).alias("pass_linear"),
                      count(lin & ~sq).alias("pass_linear_fail_squared"),
                      count(sq & ~lin).alias("pass_squared_fail_linear"), count(lin & sq).alias("pass_both"))
