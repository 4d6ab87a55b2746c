"""Locked plans and batches of requests under one ledger.

Requests are aggregates, models, comparisons of groups, tests of normality and
series; each is charged for every cell table it plans.  Plans and batches loop over a
short, user-written list of requests (a plan holds at most 32 stages, a batch at most
the query budget); the data work of every request is an ordinary release job.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ledger import sparse_levels
from ..operators.lineage import close_pairs, contribution_difference
from ..operators.textjobs import table_digest
from ..operators.views import Workspace
from ..session import cut
from ..specs import Filter, QuerySpec, cohort_predicates, normal_form
from ..study import Policy, StudyError
from .requests import Request, planned, vet

MAX_STAGES = 32
STATUSES = ("released", "redacted", "denied", "review", "skipped")
PREDICATES = "array<struct<column:string,op:string,values:array<string>>>"


@dataclass(frozen=True)
class Stage:
    id: str
    question: str
    spec: Request
    after: str | None = None                 # run only if this stage …
    statuses: tuple[str, ...] = ()           # … ended in one of these
    exclude_sparse: str | None = None        # drop sparse levels of this dimension

    def __post_init__(self):
        if not self.id.replace("_", "").replace("-", "").isalnum():
            raise StudyError(f"stage id {self.id!r} must be alphanumeric")
        if set(self.statuses) - set(STATUSES) or (self.after and not self.statuses):
            raise StudyError(f"stage {self.id!r}: bad guard statuses")


@dataclass(frozen=True)
class Plan:
    question: str
    stages: tuple[Stage, ...]

    def __post_init__(self):
        if not 1 <= len(self.stages) <= MAX_STAGES:
            raise StudyError(f"a plan has 1..{MAX_STAGES} stages")
        seen: set[str] = set()
        for stage in self.stages:
            if stage.id in seen:
                raise StudyError(f"duplicate stage id {stage.id!r}")
            if stage.after is not None and stage.after not in seen:
                raise StudyError(f"stage {stage.id!r} waits for a later stage")
            seen.add(stage.id)

    def digest(self) -> str:
        """Stable hash of the plan; changes with any field or with the order."""
        text = json.dumps(asdict(self), sort_keys=True, separators=(",", ":"), default=str)
        return hashlib.sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class StageResult:
    """Outcome of a stage; ``released`` is its main table, ``tables`` all of them, ``digest`` covers all."""

    id: str
    status: str
    reason: str = ""
    released: DataFrame | None = None
    digest: str | None = None
    excluded: tuple[str, ...] = ()
    tables: dict[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class Entry:
    """One planned table in the ledger; the total is None for a table that was not looked at."""

    role: str
    measure: str
    cohort_id: str
    persons_total: int | None
    spent: int


@dataclass(frozen=True)
class Answer:
    """Outcome of a request: all its tables, or none."""

    status: str
    reason: str
    entries: tuple[Entry, ...]
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def table(self) -> DataFrame | None:
        return next(iter(self.tables.values()), None)


def cohort_of(spec: QuerySpec) -> tuple[str, list]:
    """Cohort id and predicates of a request."""
    predicates = cohort_predicates(spec.filters)
    return json.dumps([spec.view, predicates]), predicates


class Session:
    """What a user has been given so far, and what that rules out.

    One unit is spent per planned table that is looked at; a request whose tables are
    not all affordable runs nothing and spends nothing.  A request is refused when it is over
    the budget, when its person total is near an earlier one of the same measure,
    or when its cohort is near an earlier released one: on the same view over
    fewer than ``delta`` persons, on another view over the persons whose
    contribution to the same declared quantity differs.  Equal predicates are the
    same cohort on any view and rule nothing out.
    """

    def __init__(self, ws: Workspace, policy: Policy):
        self.ws, self.policy = ws, policy
        self.spent, self.totals, self.released = 0, [], []

    def affords(self, units: int = 1) -> bool:
        return self.spent + units <= self.policy.budget

    def near_total(self, measure: str, total: int) -> bool:
        """Whether the total is near an earlier one; it is remembered either way."""
        near = any(m == measure and 0 < abs(t - total) < self.policy.delta for m, t in self.totals)
        self.totals.append((measure, total))
        return near

    def quantity(self, spec: QuerySpec) -> str | None:
        column = spec.measure.column
        return self.ws.study.quantity_of(spec.view, column) if column else None

    def near_cohort(self, spec: QuerySpec, close=None) -> bool:
        """Whether an earlier released cohort is too close.

        ``close(earlier, this)`` may answer for two cohort ids of one view; without
        it the pair is settled by a job of its own.
        """
        cohort, predicates = cohort_of(spec)
        own = normal_form(spec.filters)
        others = [r for r in self.released if normal_form(r[2]) != own]
        here = {earlier: filters for view, earlier, filters, _ in others if view == spec.view}
        if close is None and here:
            # all earlier cohorts of the view in one job, at most a budget of them
            rows = [(c, spec.view, cohort_predicates(f)) for c, f in here.items()]
            table = self.ws.spark(spec.view).createDataFrame(
                [*rows, (cohort, spec.view, predicates)], f"cohort_id string, view string, predicates {PREDICATES}")
            pairs = close_pairs(self.ws, spec.view, table, self.policy.delta, self.policy.min_persons)
            mine = (F.col("cohort_a") == cohort) | (F.col("cohort_b") == cohort)
            if not pairs.where(mine).isEmpty():
                return True
        elif any(close(earlier, cohort) for earlier in here):
            return True
        quantity = self.quantity(spec)
        return quantity is not None and any(
            contribution_difference(self.ws, quantity, view, filters, spec.view, spec.filters).first()["n_persons"] < self.policy.delta
            for view, _, filters, earlier in others if view != spec.view and earlier == quantity)

    def record(self, spec: QuerySpec) -> None:
        self.released.append((spec.view, cohort_of(spec)[0], spec.filters, self.quantity(spec)))

    def run(self, spec: Request, close=None) -> Answer:
        """Run one request of any kind; its released tables are written out.

        Planned tables are looked at in order until one refuses the request.  Their
        cohorts are not compared with each other, since they are released together, and
        are remembered only if the whole request is released.
        """
        tables = planned(spec)
        entry = lambda p, total=None: Entry(p.role, p.key, cohort_of(p.query)[0], total, self.spent)
        if not self.affords(len(tables)):
            return Answer("denied", "query_budget", tuple(entry(p) for p in tables))
        vetted = vet(self.ws, spec, self.policy)
        entries, used, reason = [], [], ""
        for p in tables:
            if reason:
                entries.append(entry(p))
                continue
            verdict = vetted.verdicts[p.role]
            self.spent += 1
            entries.append(entry(p, verdict.persons))
            near = self.near_total(p.key, verdict.persons)
            if near or self.near_cohort(p.query, close):
                reason = "differencing"
            elif not verdict.failing:
                used.append(p)
            elif p.required:
                reason = "nothing released"
        if reason:
            return Answer("denied", reason, tuple(entries))
        if any(vetted.verdicts[p.role].cells > self.policy.max_cells for p in used):
            return Answer("review", "too granular", tuple(entries))
        done = vetted.finish({p.role for p in used})
        if done.status not in ("released", "redacted"):
            return Answer(done.status, done.reason, tuple(entries))
        for p in used:
            self.record(p.query)
        return Answer(done.status, done.reason, tuple(entries), {name: cut(t) for name, t in done.tables.items()})

    def request(self, spec: Request, close=None) -> tuple[str, str, int | None, DataFrame | None]:
        """Status, reason, person total of the first table and the main released table."""
        answer = self.run(spec, close)
        return answer.status, answer.reason, answer.entries[0].persons_total, answer.table


def joint_digest(tables: dict[str, DataFrame]) -> str | None:
    """Digest of a released table, or of the digests of several under their names."""
    digests = {name: table_digest(t).first()["digest"] for name, t in tables.items()}
    if len(digests) < 2:
        return next(iter(digests.values()), None)
    return hashlib.sha256(json.dumps(digests, sort_keys=True).encode()).hexdigest()


def run_plan(ws: Workspace, plan: Plan, policy: Policy | None = None, session: Session | None = None) -> list[StageResult]:
    """Run the stages in order under one session; each released table is written out once.

    ``session`` carries on from earlier requests of the same user.
    """
    policy = policy or Policy()
    session = session or Session(ws, policy)
    done: dict[str, StageResult] = {}
    bits = policy.selection_bits
    for stage in plan.stages:
        if stage.after and done[stage.after].status not in stage.statuses:
            done[stage.id] = StageResult(stage.id, "skipped", f"guard on {stage.after} not met")
            continue
        spec, excluded = stage.spec, ()
        if stage.exclude_sparse:
            # declared levels only: a short list
            rows = sparse_levels(ws, spec.view, stage.exclude_sparse, spec.filters, policy).collect()
            excluded = tuple(sorted(r["level"] for r in rows))
            if len(excluded) > bits:
                done[stage.id] = StageResult(stage.id, "denied", "selection budget exhausted")
                continue
            bits -= len(excluded)
            spec = replace(spec, filters=spec.filters + tuple(
                Filter(stage.exclude_sparse, "!=", level) for level in excluded))
        answer = session.run(spec)
        done[stage.id] = StageResult(stage.id, answer.status, answer.reason, answer.table,
                                     joint_digest(answer.tables), excluded, answer.tables)
    return [done[s.id] for s in plan.stages]


def run_batch(ws: Workspace, specs: list[Request], policy: Policy | None = None,
              user: str = "user") -> tuple[list[Answer], DataFrame]:
    """Run requests in order under one session: budget, totals, lineage, gateway.

    Which cohorts are too close to each other is settled for the whole batch, second
    cohorts of models included, by one job per view; the order then decides which of a
    pair is refused.  Returns the answers and the ledger, one row per planned table:
    user, seq, role, measure, cohort_id, persons_total, cost, spent, status, reason.
    """
    policy = policy or Policy()
    spark = ws.spark(specs[0].view)
    queries = [p.query for s in specs for p in planned(s)]
    close: set[frozenset] = set()
    for view in sorted({q.view for q in queries}):
        rows = {cohort_of(q)[0]: (cohort_of(q)[0], view, cohort_of(q)[1]) for q in queries if q.view == view}
        if len(rows) > 1:
            table = spark.createDataFrame(list(rows.values()),
                                          f"cohort_id string, view string, predicates {PREDICATES}")
            # at most one row per pair of cohorts of the batch
            close |= {frozenset((r["cohort_a"], r["cohort_b"]))
                      for r in close_pairs(ws, view, table, policy.delta, policy.min_persons).collect()}
    session, answers, ledger = Session(ws, policy), [], []
    for seq, spec in enumerate(specs, 1):
        answer = session.run(spec, lambda a, b: frozenset((a, b)) in close)
        answers.append(answer)
        ledger += [(user, seq, e.role, e.measure, e.cohort_id, e.persons_total, 1, e.spent, answer.status, answer.reason)
                   for e in answer.entries]
    return answers, spark.createDataFrame(
        ledger, "user string, seq long, role string, measure string, cohort_id string, persons_total long, "
                "cost int, spent long, status string, reason string")
