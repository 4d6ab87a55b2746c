"""What a study is: tables with disclosure roles, public views over them, policy.

Everything here is plain declaration.  No data is read; the declaration is
checked for consistency when it is built and against real DataFrame schemas in
:func:`Study.check_tables`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

PERSON = "_person"

# The disclosure roles a column may have.
ROLES = {
    "DI": "direct identifier",
    "QI": "quasi-identifier",
    "S": "sensitive",
    "R": "reference",
    "meta": "structural",
}
# Kinds of a dimension and the model families a response may allow.
DIM_KINDS = ("cat", "int", "bool")
FAMILIES = ("gaussian", "binomial", "poisson")

_NAME = re.compile(r"^[a-z_][a-z0-9_]*$")


class StudyError(ValueError):
    """A declaration that cannot be used."""


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise StudyError(message)


def _name(value: str, what: str) -> str:
    _need(bool(_NAME.match(value)), f"{what} {value!r} is not a legal name")
    return value


def split_ref(ref: str) -> tuple[str, str]:
    table, dot, column = ref.partition(".")
    _need(bool(dot), f"{ref!r} must be written <table>.<column>")
    return _name(table, "table"), _name(column, "column")


@dataclass(frozen=True)
class Join:
    """Equi-join of one more table: ``left`` is an already reachable column."""

    table: str
    left: str
    right: str
    how: str = "inner"


@dataclass(frozen=True)
class SumIf:
    """Sum of ``column`` over rows whose ``when`` is one of ``among``, else 0."""

    column: str
    when: str
    among: tuple

    def refs(self) -> tuple[str, ...]:
        return (self.column, self.when)


@dataclass(frozen=True)
class CountIf:
    """Number of rows whose ``column`` equals ``equals``."""

    column: str
    equals: Any

    def refs(self) -> tuple[str, ...]:
        return (self.column,)


@dataclass(frozen=True)
class BandEdges:
    """Edges of a banded internal column: inclusive lower and upper bounds."""

    lower: tuple
    upper: tuple

    def __post_init__(self):
        _need(bool(self.lower) or bool(self.upper), "a range rule needs edges")
        if self.lower and self.upper:
            _need(len(self.lower) == len(self.upper),
                  "lower and upper edges must describe the same bands")

    def allows(self, op: str, value: Any) -> bool:
        return value in {">=": self.lower, "<=": self.upper}.get(op, ())


@dataclass(frozen=True)
class View:
    """A public dataset and the internal, person-keyed form of it.

    ``columns`` maps output names to ``table.column`` or to a conditional
    rollup; a view with any rollup column is grouped by person and by its plain
    columns.
    """

    base: str
    person: str
    columns: dict[str, Any]
    joins: tuple[Join, ...] = ()
    unit_columns: dict[str, str] = field(default_factory=dict)
    dims: dict[str, str] = field(default_factory=dict)
    measures: tuple[str, ...] = ()
    internal_filters: dict[str, str] = field(default_factory=dict)
    internal_measures: tuple[str, ...] = ()
    responses: dict[str, tuple[str, ...]] = field(default_factory=dict)
    time_dims: tuple[str, ...] = ()
    population: str | None = None

    @property
    def is_rollup(self) -> bool:
        return any(not isinstance(c, str) for c in self.columns.values())

    def filter_kinds(self) -> dict[str, str]:
        return {**self.dims, **self.internal_filters}


@dataclass(frozen=True)
class Policy:
    """Thresholds that decide what may be released."""

    min_persons: int = 10
    max_cells: int = 100
    dominance: float = 0.5
    influence: float = 0.5
    second_moment_dominance: float | None = None
    round_base: int = 5
    budget: int = 20
    delta: int = 10
    selection_bits: int = 4

    def __post_init__(self):
        _need(self.min_persons >= 1, "min_persons must be at least 1")
        _need(self.round_base >= 5, "round_base must be at least 5")
        _need(0 < self.dominance <= 0.5, "dominance must be in (0, 0.5]")
        _need(0 < self.influence <= 0.5, "influence must be in (0, 0.5]")
        _need(self.second_moment_dominance is None
              or 0 < self.second_moment_dominance <= 1,
              "second_moment_dominance must be in (0, 1]")
        _need(1 <= self.budget <= 1000, "budget must be in 1..1000")
        _need(0 <= self.selection_bits <= 16, "selection_bits must be in 0..16")

    def dominance_for(self, value_class: str) -> float:
        if value_class == "moment2" and self.second_moment_dominance is not None:
            return self.second_moment_dominance
        return self.dominance


@dataclass(frozen=True)
class Study:
    name: str
    tables: dict[str, dict[str, str]]
    views: dict[str, View]
    domains: dict[str, tuple] = field(default_factory=dict)
    descriptions: dict[str, str] = field(default_factory=dict)
    derived_roles: dict[str, str] = field(default_factory=dict)
    quantities: dict[str, dict[str, str]] = field(default_factory=dict)
    bands: dict[str, BandEdges] = field(default_factory=dict)
    synonyms: dict[str, str] = field(default_factory=dict)
    free_text: frozenset = frozenset({"free_text"})

    def __post_init__(self):
        _need(bool(self.tables), "a study needs at least one table")
        for table, columns in self.tables.items():
            _name(table, "table")
            _need(bool(columns), f"table {table!r} has no columns")
            for column, role in columns.items():
                _name(column, f"column of {table!r}")
                _need(role in ROLES, f"{table}.{column}: unknown role {role!r}")
        for column, role in self.derived_roles.items():
            _name(column, "derived column")
            _need(role in ROLES, f"derived {column!r}: unknown role {role!r}")
        for name, view in self.views.items():
            _name(name, "view")
            self._check_view(name, view)
        self._check_quantities()
        internal = {c for v in self.views.values() for c in v.internal_filters}
        for column in self.bands:
            _need(column in internal, f"range rule for {column!r}: not an internal filter")
        dims = {d for v in self.views.values() for d in v.dims}
        for phrase, dim in self.synonyms.items():
            _need(dim in dims, f"synonym {phrase!r} names {dim!r}, not a dimension")

    # -- declaration checks ------------------------------------------------
    def _has(self, ref: str, reachable: set[str], where: str) -> None:
        table, column = split_ref(ref)
        _need(table in reachable, f"{where}: {table!r} is not part of this view")
        _need(column in self.tables[table], f"{where}: no column {ref!r}")

    def _check_view(self, name: str, view: View) -> None:
        _need(view.base in self.tables, f"{name}: unknown base table {view.base!r}")
        reachable = {view.base}
        for join in view.joins:
            _need(join.table in self.tables, f"{name}: unknown table {join.table!r}")
            _need(join.table not in reachable, f"{name}: {join.table!r} enters twice")
            _need(join.how in ("inner", "left"), f"{name}: join must be inner or left")
            self._has(join.left, reachable, name)
            reachable.add(join.table)
            self._has(f"{join.table}.{join.right}", reachable, name)
        self._has(view.person, reachable, name)
        ptable, pcolumn = split_ref(view.person)
        _need(self.tables[ptable][pcolumn] == "DI", f"{name}: the person key must be DI")
        for out, source in view.columns.items():
            _name(out, f"{name} column")
            for ref in ([source] if isinstance(source, str) else source.refs()):
                self._has(ref, reachable, name)
            if isinstance(source, str):
                table, column = split_ref(source)
                _need(self.tables[table][column] != "DI",
                      f"{name}: public column {out!r} exposes an identifier")
        for out, source in view.unit_columns.items():
            _name(out, f"{name} internal column")
            _need(out not in view.columns and out != PERSON,
                  f"{name}: internal column {out!r} collides")
            self._has(source, reachable, name)
        for kinds in (view.dims, view.internal_filters):
            for column, kind in kinds.items():
                _need(kind in DIM_KINDS, f"{name}.{column}: unknown kind {kind!r}")
        unit = set(view.columns) | set(view.unit_columns)
        _need(set(view.dims) <= set(view.columns), f"{name}: dims outside the view")
        _need(set(view.measures) <= set(view.columns), f"{name}: measures outside the view")
        _need(set(view.internal_filters) <= unit and set(view.internal_measures) <= unit,
              f"{name}: internal columns outside the unit view")
        _need(not set(view.dims) & set(view.internal_filters),
              f"{name}: a column is both dim and internal filter")
        _need(not set(view.measures) & set(view.internal_measures),
              f"{name}: a column is both measure and internal measure")
        for column in view.time_dims:
            _need(view.dims.get(column) == "int", f"{name}: time dim {column!r} must be an int dim")
        for response, families in view.responses.items():
            _need(response in view.dims or response in view.measures,
                  f"{name}: response {response!r} is no dim or measure")
            _need(set(families) <= set(FAMILIES), f"{name}: unknown family for {response!r}")

    def _check_quantities(self) -> None:
        owner: dict[tuple[str, str], str] = {}
        for quantity, members in self.quantities.items():
            _need(len(members) >= 2, f"quantity {quantity!r} needs two members")
            for view, column in members.items():
                _need(view in self.views, f"quantity {quantity!r}: unknown view {view!r}")
                _need(column in self.views[view].measures,
                      f"quantity {quantity!r}: {view}.{column} is no measure")
                _need((view, column) not in owner, f"{view}.{column} has two quantities")
                owner[(view, column)] = quantity

    def check_tables(self, tables: dict) -> None:
        """Every declared table and column must exist in the given DataFrames."""
        for table, columns in self.tables.items():
            _need(table in tables, f"missing table {table!r}")
            absent = set(columns) - set(tables[table].columns)
            _need(not absent, f"table {table!r} lacks {sorted(absent)}")

    # -- lookups -----------------------------------------------------------
    def view(self, name: str) -> View:
        _need(name in self.views, f"unknown view {name!r} (known: {sorted(self.views)})")
        return self.views[name]

    def domain(self, column: str) -> tuple | None:
        return self.domains.get(column)

    def quantity_of(self, view: str, column: str | None) -> str | None:
        for quantity, members in self.quantities.items():
            if column is not None and members.get(view) == column:
                return quantity
        return None

    def population_of(self, view: str) -> str:
        v = self.view(view)
        return v.population or split_ref(v.person)[1]

    @cached_property
    def _roles(self) -> dict[str, set[str]]:
        """Column → every role it is declared with: that of the derived column, or those of the tables."""
        index: dict[str, set[str]] = {}
        for declared in (*self.tables.values(), self.derived_roles):
            for column, role in declared.items():
                index.setdefault(column, set()).add(role)
        return index

    def role_of(self, column: str) -> str | None:
        if column in self.derived_roles:
            return self.derived_roles[column]
        return next((columns[column] for columns in self.tables.values() if column in columns), None)

    def having_role(self, role: str) -> set[str]:
        """Columns declared with a role; the person column of a view counts as an identifier."""
        persons = {PERSON} if role == "DI" else set()
        return persons | {column for column, roles in self._roles.items() if role in roles}

    def with_domains(self, **domains: tuple) -> "Study":
        return replace(self, domains={**self.domains, **domains})
