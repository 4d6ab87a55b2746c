"""Requests of every kind as planned cell tables.

A plain aggregate plans one table.  A model, a comparison of groups, a test of
normality or a series plans one table per sum it needs; all of them come from one
per-person aggregate, are judged in one pass over the written cells, and are
released together or not at all.  Each table counts as a release of its own in
the ledger, with its own cohort: the successes of a binomial model are one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cellstats
from ..operators.gateway import release
from ..operators.models import PLANS, REQUIRED, fit_vetted, gaussian_tables, successes_filter
from ..operators.views import Workspace
from ..session import cut
from ..specs import FactorSpec, GlmSpec, Measure, QuerySpec, SeriesSpec
from ..study import Policy, StudyError

Request = QuerySpec | GlmSpec | FactorSpec | SeriesSpec

# The sums each kind of request needs, by the measure that gives them.
SUMS = {"gaussian": ("mean", "sum_sq"), "poisson": ("sum",), "anova": ("mean", "sum_sq"), "normality": cellstats.POWER_SUMS}


@dataclass(frozen=True)
class Planned:
    """One cell table of a request; a table that is not required may be left out of what is released."""

    role: str
    query: QuerySpec
    required: bool = True

    @property
    def key(self) -> str:
        """What person totals are compared under: tables of one role and measure."""
        return self.query.measure_key() + (f"#{self.role}" if self.role else "")


def planned(spec: Request) -> tuple[Planned, ...]:
    """The cell tables a request needs, in the order in which they are charged."""
    if isinstance(spec, QuerySpec):
        return (Planned("", spec),)
    if isinstance(spec, SeriesSpec):
        return (Planned("series", QuerySpec(spec.view, Measure(spec.stat, spec.response), (spec.time,), spec.filters)),)
    if isinstance(spec, FactorSpec):
        return tuple(Planned(fn, QuerySpec(spec.view, Measure(fn, spec.response), (spec.factor,), spec.filters))
                     for fn in SUMS[spec.tool])
    if not isinstance(spec, GlmSpec):
        raise StudyError(f"no plan for a request of type {type(spec).__name__}")
    base = QuerySpec(spec.view, Measure("count"), spec.terms, spec.filters)
    if spec.family == "binomial":
        return (Planned("trials", base),
                Planned("successes", replace(base, filters=(*spec.filters, successes_filter(spec)))))
    return tuple(Planned(fn, replace(base, measure=Measure(fn, spec.response)), f"fails_{fn}" in REQUIRED[spec.family])
                 for fn in SUMS[spec.family])


@dataclass(frozen=True)
class Verdict:
    """What the rules found in one planned table."""

    cells: int
    persons: int
    failing: bool


@dataclass(frozen=True)
class Released:
    """Outcome of a request and its tables, the first being the main one."""

    status: str
    reason: str = ""
    tables: dict[str, DataFrame] | None = None


@dataclass(frozen=True)
class Vetted:
    """A request whose cells are written and judged; ``finish(roles)`` releases from the roles that may be used."""

    verdicts: dict[str, Verdict]
    finish: Callable[[set[str]], Released]


def _verdicts(table: DataFrame, columns: dict[str, tuple]) -> dict[str, Verdict]:
    """Verdict per role from one pass: role → (present, failing, persons) as Columns."""
    terms = []
    for role, (present, failing, persons) in columns.items():
        terms += [F.count_if(present).alias(f"{role}_k"), F.coalesce(F.sum(F.when(present, persons)), F.lit(0)).alias(f"{role}_p"),
                  F.coalesce(F.bool_or(failing), F.lit(False)).alias(f"{role}_f")]
    row = table.agg(*terms).first()
    # a table without cells is none that a fit could use
    return {r: Verdict(row[f"{r}_k"], int(row[f"{r}_p"]), row[f"{r}_f"] or not row[f"{r}_k"]) for r in columns}


def _columns(roles) -> dict[str, tuple]:
    return {r: (F.lit(True), F.col(f"fails_{r}"), F.col("raw_persons")) for r in roles}


def vet(ws: Workspace, spec: Request, policy: Policy) -> Vetted:
    """Run a request's aggregate, write its cells once and judge every planned table."""
    spec.check(ws.study)
    if isinstance(spec, QuerySpec):
        return _vet_plain(ws, spec, policy)
    if isinstance(spec, SeriesSpec):
        return _vet_series(ws, spec, policy)
    if isinstance(spec, FactorSpec):
        return _vet_factor(ws, spec, policy)
    table = cut(PLANS[spec.family](ws, spec.view, spec.response, list(spec.terms), spec.filters, policy))
    if spec.family == "binomial":
        hit = F.col("raw_k") > 0
        columns = {"trials": (F.lit(True), F.col("fails_trials"), F.col("raw_persons")),
                   "successes": (hit, F.col("fails_successes"), F.col("raw_k_persons"))}
    else:
        columns = _columns(SUMS[spec.family])

    def finish(roles: set[str]) -> Released:
        model = fit_vetted(table, spec, ws.study, spec.family == "gaussian" and "sum_sq" not in roles)
        if model.status != "released":
            return Released(model.status, "unestimable")
        return Released("released", "", {"coefficients": model.coefficients, "summary": model.summary, "cells": model.cells})

    return Vetted(_verdicts(table, columns), finish)


def _vet_plain(ws: Workspace, spec: QuerySpec, policy: Policy) -> Vetted:
    out = release(ws, spec, policy)
    row = out.vetted.agg(F.coalesce(F.sum("n_persons"), F.lit(0)).alias("p")).first()

    def finish(_) -> Released:
        outcome = out.outcome.first()["outcome"]
        if outcome in ("released", "redacted"):
            return Released(outcome, "", {"table": out.released})
        return Released(outcome, {"denied": "nothing released", "review": "too granular"}.get(outcome, ""))

    # withheld cells and the number of cells are settled by the release itself
    return Vetted({"": Verdict(0, int(row["p"]), False)}, finish)


def _vet_factor(ws: Workspace, spec: FactorSpec, policy: Policy) -> Vetted:
    if spec.tool == "anova":
        table = cut(gaussian_tables(ws, spec.view, spec.response, [spec.factor], spec.filters, policy))
    else:
        table = cut(cellstats.power_sum_tables(ws, spec, policy))
    released = table.select(*[c for c in table.columns if not c.startswith(("fails_", "raw_"))])

    def finish(_) -> Released:
        if spec.tool == "normality":
            return Released("released", "", {"levels": cellstats.normality(released, spec.factor), "cells": released})
        groups = released.withColumn("withheld", F.lit(False))
        if not cellstats.anova_problems(groups).isEmpty():
            return Released("denied", "unestimable")
        rows, model = cellstats.anova_released(groups, spec.factor)
        return Released("released", "", {"sources": rows, "summary": model, "cells": released})

    return Vetted(_verdicts(table, _columns(SUMS[spec.tool])), finish)


def _vet_series(ws: Workspace, spec: SeriesSpec, policy: Policy) -> Vetted:
    judged = cellstats.judged_windows(ws, spec, policy)

    def finish(_) -> Released:
        windows = cellstats.series_windows(ws, spec, policy, judged)
        if not cellstats.series_problems(windows, spec.time).isEmpty():
            return Released("denied", "unestimable")
        return Released("released", "", {"diagnostics": cellstats.series_diagnostics(windows, spec.time),
                                         "cells": windows.drop("withheld")})

    return Vetted(_verdicts(judged, {"series": (F.lit(True), F.col("withheld"), F.col("n_persons"))}), finish)
