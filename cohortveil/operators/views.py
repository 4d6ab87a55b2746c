"""Views over base tables: joins, rollups, bands, panels, and per-person sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..specs import Filter
from ..study import PERSON, BandEdges, Study, StudyError, SumIf, View, split_ref
from .predicates import conjunction, not_null


def flat(ref: str) -> str:
    """Name of a base column once tables are joined."""
    return ref.replace(".", "__")


def rollup_term(source) -> Column:
    if isinstance(source, SumIf):
        hit = F.col(flat(source.when)).isin(list(source.among))
        return F.sum(F.when(hit, F.col(flat(source.column))).otherwise(F.lit(0)))
    hit = F.col(flat(source.column)) == F.lit(source.equals)
    return F.sum(F.when(hit, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


class LazyTables(dict):
    """Tables loaded, and checked against the study, when first touched."""

    def __init__(self, study: Study, load):
        super().__init__()
        self._study, self._load = study, load

    def __missing__(self, name: str) -> DataFrame:
        df = self._load(name)
        absent = set(self._study.tables.get(name, {})) - set(df.columns)
        if absent:
            raise StudyError(f"table {name!r} lacks {sorted(absent)}")
        self[name] = df
        return df


class Workspace:
    """A study bound to DataFrames; builds every view lazily."""

    def __init__(self, study: Study, tables: dict[str, DataFrame], checked: bool = False):
        """``checked`` tables may be loaded on first use; see :class:`LazyTables`."""
        if not checked:
            study.check_tables(tables)
        self.study = study
        self.tables = tables

    def spark(self, view: str):
        return self.tables[self.study.view(view).base].sparkSession

    # -- building blocks ---------------------------------------------------
    def _source(self, table: str, refs: set[str]) -> DataFrame:
        """Only the needed columns of a table, under their flat names."""
        mine = sorted(r for r in refs if split_ref(r)[0] == table)
        return self.tables[table].select(
            *(F.col(split_ref(r)[1]).alias(flat(r)) for r in mine))

    @staticmethod
    def _refs(view: View, unit: bool) -> set[str]:
        refs = {view.person} if unit else set()
        if unit:
            refs |= set(view.unit_columns.values())
        for source in view.columns.values():
            refs |= {source} if isinstance(source, str) else set(source.refs())
        for join in view.joins:
            refs |= {join.left, f"{join.table}.{join.right}"}
        return refs

    def _join(self, df: DataFrame, view: View, refs: set[str], skip=()) -> DataFrame:
        for join in view.joins:
            if join.table in skip:
                continue
            right = self._source(join.table, refs)
            on = F.col(flat(join.left)) == F.col(flat(f"{join.table}.{join.right}"))
            df = df.join(right, on, join.how)
        return df

    # -- views -------------------------------------------------------------
    def public(self, name: str) -> DataFrame:
        """Allowlisted columns only; a rollup view keeps one row per person."""
        view = self.study.view(name)
        if view.is_rollup:
            return self._rollup(view).drop(PERSON, *view.unit_columns)
        refs = self._refs(view, unit=False)
        df = self._join(self._source(view.base, refs), view, refs)
        return df.select(*(F.col(flat(s)).alias(o) for o, s in view.columns.items()))

    def unit(self, name: str) -> DataFrame:
        """Public columns plus the person key and internal columns."""
        view = self.study.view(name)
        if view.is_rollup:
            return self._rollup(view)
        refs = self._refs(view, unit=True)
        df = self._join(self._source(view.base, refs), view, refs)
        return df.select(
            F.col(flat(view.person)).alias(PERSON),
            *(F.col(flat(s)).alias(o) for o, s in view.unit_columns.items()),
            *(F.col(flat(s)).alias(o) for o, s in view.columns.items()))

    def _rollup(self, view: View) -> DataFrame:
        """One row per person and plain column values.

        When all conditional sums read one joined table, that table is summed
        per join key before the join, so only one row per key is joined.
        """
        refs = self._refs(view, unit=True)
        derived = {o: s for o, s in view.columns.items() if not isinstance(s, str)}
        plain = {o: s for o, s in view.columns.items() if isinstance(s, str)}
        owners = {split_ref(r)[0] for s in derived.values() for r in s.refs()}
        facts = [j for j in view.joins if {j.table} == owners]
        used_later = {split_ref(j.left)[0] for j in view.joins} | {
            split_ref(r)[0] for r in [view.person, *plain.values(), *view.unit_columns.values()]}
        keys = [F.col(flat(view.person)).alias(PERSON),
                *(F.col(flat(s)).alias(o) for o, s in view.unit_columns.items()),
                *(F.col(flat(s)).alias(o) for o, s in plain.items())]
        if len(facts) == 1 and facts[0].table not in used_later:
            fact = facts[0]
            key = flat(f"{fact.table}.{fact.right}")
            sums = (self._source(fact.table, refs).groupBy(key)
                    .agg(*(rollup_term(s).alias(o) for o, s in derived.items())))
            df = self._join(self._source(view.base, refs), view, refs, skip={fact.table})
            df = df.join(sums, F.col(flat(fact.left)) == F.col(key), fact.how)
            terms = []
            for out in derived:
                zero = F.lit(0).cast(sums.schema[out].dataType)
                part = F.when(F.col(key).isNull(), zero).otherwise(F.col(out))
                terms.append(F.sum(part).cast(sums.schema[out].dataType).alias(out))
        else:
            df = self._join(self._source(view.base, refs), view, refs)
            terms = [rollup_term(s).alias(o) for o, s in derived.items()]
        out = df.groupBy(*keys).agg(*terms)
        return out.select(PERSON, *view.unit_columns, *view.columns)

    def register(self, prefix: str = "") -> list[str]:
        """Temp views for the public datasets, under their own names."""
        names = []
        for name in sorted(self.study.views):
            self.public(name).createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
        return names

    # -- the shared first step of every safe aggregate -----------------------
    def per_person(self, name: str, keys=(), filters: tuple[Filter, ...] = (),
                   guards=(), parts=None) -> DataFrame:
        """Row count and additive parts per (cell key, person).

        ``parts(column)`` returns named Column expressions, where ``column`` maps
        an output name to a Column.
        """
        parts = parts or (lambda column: {})
        terms = lambda column: {"_n": F.count(F.lit(1)), **{k: F.sum(e) for k, e in parts(column).items()}}
        rows, several = self.leaves(name, keys, filters, guards, terms)
        if not several:
            return rows
        names = [c for c in rows.columns if c not in keys and c != PERSON]
        return rows.groupBy(*keys, PERSON).agg(*(F.sum(c).alias(c) for c in names))

    def leaves(self, name: str, keys=(), filters: tuple[Filter, ...] = (),
               guards=(), terms=None) -> tuple[DataFrame, bool]:
        """First aggregate of a person's rows in a cell, and whether a person can have several.

        ``terms(column)`` returns named aggregates of columns.  If the base table carries
        the person key, rows are aggregated on the base table before the dimension tables
        are joined, so a person with very many rows is already collapsed on the map side
        and the joins see one row per person and base-side key; those rows are still to be
        merged.  States that do not add up as they are (means, centred moments) are merged
        by the caller.
        """
        view = self.study.view(name)
        keys = list(keys)
        source = {**view.columns, **view.unit_columns}
        on_base = lambda c: isinstance(source[c], str) and split_ref(source[c])[0] == view.base
        touched = set(guards) | {c for c in self._part_columns(terms)}
        early = (not view.is_rollup and view.joins
                 and split_ref(view.person)[0] == view.base
                 and all(on_base(c) for c in touched))
        if not early:
            df = (self.unit(name).where(conjunction(filters)).where(not_null(guards)))
            return df.groupBy(*keys, PERSON).agg(*(e.alias(k) for k, e in terms(F.col).items())), False

        base_keys = [k for k in keys if on_base(k)]
        refs = {view.person} | {source[c] for c in set(keys) | touched | {f.column for f in filters}}
        for join in view.joins:
            refs |= {join.left, f"{join.table}.{join.right}"}
        named = lambda c: F.col(flat(source[c]))
        first = [f for f in filters if on_base(f.column)]
        later = [f for f in filters if not on_base(f.column)]
        links = {flat(j.left) for j in view.joins if split_ref(j.left)[0] == view.base}
        group = sorted(links | {flat(view.person)} | {flat(source[k]) for k in base_keys})
        expressions = terms(named)
        df = (self._source(view.base, refs)
              .where(conjunction(first, named)).where(not_null(guards, named))
              .groupBy(*group).agg(*(e.alias(k) for k, e in expressions.items())))
        df = self._join(df, view, refs).where(conjunction(later, named))
        return df.select(*(F.col(flat(source[k])).alias(k) for k in keys),
                         F.col(flat(view.person)).alias(PERSON), *expressions), True

    @staticmethod
    def _part_columns(parts) -> set[str]:
        seen: set[str] = set()

        def note(name):
            seen.add(name)
            return F.col(name)

        parts(note)
        return seen


def band_by_cuts(value: Column, cuts, labels) -> Column:
    """Label of the first cut the value does not exceed; the last label beyond."""
    if len(labels) != len(cuts) + 1:
        raise StudyError("cut points need one more label than cuts")
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for cut, label in zip(cuts, labels):
        out = out.when(value <= F.lit(cut), F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def band_by_edges(value: Column, edges: BandEdges, labels, strict: bool = False) -> Column:
    """Label of the inclusive edge pair holding the value.

    Values outside every pair become NULL, or an error when ``strict``.
    """
    if not len(edges.lower) == len(edges.upper) == len(labels):
        raise StudyError("bands need as many labels as edge pairs")
    out = reduce(lambda acc, b: acc.when(value.between(F.lit(b[0]), F.lit(b[1])), F.lit(b[2])),
                 zip(edges.lower, edges.upper, labels), F.when(F.lit(False), F.lit("")))
    if strict:
        message = F.concat(F.lit("value outside every declared band: "), value.cast("string"))
        return out.otherwise(F.raise_error(message).cast("string"))
    return out


def dense_panel(persons: DataFrame, activity: DataFrame, person: str, period: str,
                first: int, last: int, sums: dict[str, str]) -> DataFrame:
    """Every person × every period of the declared range, absent sums as zero.

    The periods come from exploding a declared integer range per person, so no
    pairing of tables is needed; activity is summed before it is joined.
    """
    grid = persons.select(person).distinct().withColumn(
        period, F.explode(F.sequence(F.lit(first), F.lit(last))))
    totals = activity.groupBy(person, period).agg(
        F.count(F.lit(1)).alias("rows"), *(F.sum(c).alias(o) for o, c in sums.items()))
    return grid.join(totals, [person, period], "left").na.fill(0, ["rows"]).select(
        person, period, "rows",
        *(F.coalesce(F.col(o), F.lit(0).cast(totals.schema[o].dataType)).alias(o) for o in sums))


def data_dictionary(spark, study: Study) -> DataFrame:
    """One row per declared column: table, role, description, domain."""
    rows = []
    for table, columns in study.tables.items():
        for column, role in columns.items():
            domain = study.domain(column)
            rows.append((table, column, role, study.descriptions.get(column, ""),
                         [str(v) for v in domain] if domain else None))
    for column, role in study.derived_roles.items():
        rows.append((None, column, role, study.descriptions.get(column, ""), None))
    return spark.createDataFrame(
        rows, "table string, column string, role string, description string, domain array<string>")
