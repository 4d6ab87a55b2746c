"""Differencing: how many persons two releases differ over.

Cohorts are rows of a table (cohort_id, view, predicates); predicates are
arrays of (column, op, values-as-text).  Which rows a cohort selects depends
only on the filterable dimensions, so rows are first reduced to distinct
(dimension combination, person) pairs and cohorts become sets of combinations.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scans import running_sum
from ..session import cut
from ..specs import Filter
from ..study import PERSON
from .cells import combination_persons, long_values
from .predicates import ALL_DIM, ALL_VALUE, conjunction, matches, selected_values
from .views import Workspace


# -- one given pair ------------------------------------------------------------------

def row_difference(ws: Workspace, view: str, a: tuple[Filter, ...], b: tuple[Filter, ...],
                   null_mode: str = "rows") -> DataFrame:
    """Distinct persons behind rows exactly one of two filter lists selects.

    ``null_mode='three_valued'`` leaves out rows where a filter is NULL, as a
    plain SQL ``A AND NOT B`` would.
    """
    columns = sorted({f.column for f in (*a, *b)})
    rows = ws.per_person(view, columns)
    pa, pb = conjunction(a), conjunction(b)
    if null_mode == "rows":
        differs = F.coalesce(pa, F.lit(False)) != F.coalesce(pb, F.lit(False))
    else:
        differs = (pa & ~pb) | (pb & ~pa)
    return (rows.where(differs).select(PERSON).distinct()
            .agg(F.count(F.lit(1)).alias("n_persons")))


def person_difference(ws: Workspace, view_a: str, a: tuple[Filter, ...],
                      view_b: str, b: tuple[Filter, ...]) -> DataFrame:
    """Persons in exactly one of two cohorts, possibly on two views."""
    left = ws.per_person(view_a, (), a).select(PERSON, F.lit(1).alias("side"))
    right = ws.per_person(view_b, (), b).select(PERSON, F.lit(2).alias("side"))
    once = left.unionByName(right).groupBy(PERSON).agg(F.sum("side").alias("side"))
    return once.where("side < 3").agg(F.count(F.lit(1)).alias("n_persons"))


def contribution_difference(ws: Workspace, quantity: str, view_a: str, a: tuple[Filter, ...],
                            view_b: str, b: tuple[Filter, ...]) -> DataFrame:
    """Persons whose summed quantity differs between two releases."""
    columns = ws.study.quantities[quantity]

    def side(view, filters, sign):
        pp = ws.per_person(view, (), filters, (), lambda c: {"_s": c(columns[view])})
        return pp.select(PERSON, (F.coalesce("_s", F.lit(0)) * sign).alias("_s"))

    both = side(view_a, a, 1).unionByName(side(view_b, b, -1))
    return (both.groupBy(PERSON).agg(F.sum("_s").alias("_d")).where(F.abs("_d") > 1e-6)
            .agg(F.count(F.lit(1)).alias("n_persons")))


# -- tables of cohorts ---------------------------------------------------------------

def selections(cohorts: DataFrame, kinds: DataFrame) -> DataFrame:
    """What a cohort selects of each dimension it filters: cohort_id, view, dim, lo, hi, inc, exc.

    A whole-number range, the values listed for inclusion (NULL: all) and those excluded;
    all predicates on one dimension hold together.  ``kinds``: view, dim, kind.
    """
    p = cohorts.select("cohort_id", "view", F.explode("predicates").alias("p")).select(
        "cohort_id", "view", F.col("p.column").alias("dim"), F.col("p.op").alias("op"), F.col("p.values").alias("values"))
    is_int = F.col("kind") == "int"
    values = F.when(is_int, F.transform("values", lambda v: v.try_cast("bigint").cast("string"))).otherwise(F.col("values"))
    op, bound = F.col("op"), F.when(is_int, F.element_at("values", 1).try_cast("bigint"))
    ranged = op.isin("<", "<=", ">", ">=")
    none = F.array().cast("array<string>")
    # an order that the kind does not have, or a bound that is no number, selects nothing
    inc = F.when(op.isin("==", "in"), F.array_compact(values)).when(ranged & bound.isNull(), none)
    rows = p.join(kinds, ["view", "dim"]).select(
        "cohort_id", "view", "dim", inc.alias("inc"), F.when(op == "!=", F.array_compact(values)).alias("exc"),
        F.when(op == ">", bound + 1).when(op == ">=", bound).alias("lo"), F.when(op == "<", bound - 1).when(op == "<=", bound).alias("hi"))
    both = lambda lists: F.reduce(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0))), F.get(lists, F.lit(0)),
                                  lambda x, y: F.array_intersect(x, y))
    grouped = rows.groupBy("cohort_id", "view", "dim").agg(
        F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.collect_list("inc").alias("incs"), F.flatten(F.collect_list("exc")).alias("exc"))
    return grouped.select("cohort_id", "view", "dim", "lo", "hi", F.when(F.size("incs") > 0, F.array_sort(F.array_distinct(both(F.col("incs"))))).alias("inc"),
                          F.array_sort(F.array_distinct("exc")).alias("exc"))


_SELECTION = ("lo", "hi", "inc", "exc")


def _selection_key(*columns: str) -> Column:
    return F.to_json(F.struct(*(F.col(c).alias(k) for c, k in zip(columns, _SELECTION))), {"ignoreNullFields": "false"})


def selection_sizes(chosen: DataFrame, marginal_table: DataFrame) -> DataFrame:
    """view, dim, key, size: marginals added up over each distinct selection.

    A range is two look-ups in the running total of its dimension; a listed or excluded value is
    one look-up.  No selection meets the values it does not name.
    """
    distinct = cut(chosen.select("view", "dim", *_SELECTION, _selection_key(*_SELECTION).alias("key")).distinct())
    inside = lambda v: (F.coalesce(v.try_cast("bigint") >= F.col("lo"), F.col("lo").isNull())
                        & F.coalesce(v.try_cast("bigint") <= F.col("hi"), F.col("hi").isNull()))
    named = F.when(F.col("inc").isNotNull(), F.filter("inc", lambda v: inside(v) & ~F.array_contains("exc", v))).otherwise(F.filter("exc", inside))
    points = distinct.select("view", "dim", "key", F.when(F.col("inc").isNull(), -1).otherwise(1).alias("sign"), F.explode(named).alias("value")).join(
        marginal_table.select("view", "dim", "value", "n_persons"), ["view", "dim", "value"]).select(
        "view", "dim", "key", (F.col("sign") * F.col("n_persons")).alias("part"))
    ranges = distinct.where("inc is null")
    ends = ranges.select("view", "dim", "key", F.inline(F.array(
        F.struct(F.lit(1).alias("sign"), F.col("hi").alias("at")), F.struct(F.lit(-1).alias("sign"), (F.col("lo") - 1).alias("at")))))
    # without an upper end a range takes the whole total of values present, without a lower end nothing off
    present = marginal_table.where("value is not null").groupBy("view", "dim").agg(F.sum("n_persons").alias("total"))
    open_ = ends.where("at is null and sign = 1").join(present, ["view", "dim"]).select("view", "dim", "key", F.col("total").alias("part"))
    asked = ends.where("at is not null").select("view", "dim", "at").distinct()
    held = marginal_table.where("kind = 'int' and value is not null").select(
        "view", "dim", F.col("value").try_cast("bigint").alias("at"), F.lit(0).alias("asked"), "n_persons")
    line = running_sum(held.unionByName(asked.select("*", F.lit(1).alias("asked"), F.lit(0).cast("bigint").alias("n_persons"))),
                       ["view", "dim"], ["at", "asked"], F.col("n_persons"), "upto").where("asked = 1").select("view", "dim", "at", "upto")
    bounds = ends.join(line, ["view", "dim", "at"]).select("view", "dim", "key", (F.col("sign") * F.col("upto")).alias("part"))
    # crossed ends select nothing
    parts = points.unionByName(open_).unionByName(bounds).groupBy("view", "dim", "key").agg(F.sum("part").alias("size"))
    crossed = F.coalesce(F.col("lo") > F.col("hi"), F.lit(False)) & F.col("inc").isNull()
    return distinct.join(parts, ["view", "dim", "key"], "left").select(
        "view", "dim", "key", F.when(crossed, 0).otherwise(F.coalesce("size", F.lit(0))).alias("size"))


def marginal_bounds(pairs: DataFrame, cohorts: DataFrame, marginal_table: DataFrame) -> DataFrame:
    """Upper bound on the difference of every listed pair from marginals alone.

    ``pairs``: cohort_a, cohort_b on one view.  Per dimension filtered by either
    side, the marginals of the values exactly one side selects are added:
    those of one and of the other, less twice those of what both select.
    """
    marginal_table, key = cut(marginal_table), ["cohort_a", "cohort_b"]
    kinds = marginal_table.select("view", "dim", "kind").distinct()
    chosen = cut(selections(cohorts, kinds))
    side = lambda p: pairs.select(*key).join(
        chosen.select(F.col("cohort_id").alias(f"cohort_{p}"), "view", "dim", *(F.col(c).alias(f"{c}_{p}") for c in _SELECTION), F.lit(True).alias(f"has_{p}")),
        f"cohort_{p}")
    # at most one row per pair and filtered dimension
    both = (side("a").unionByName(side("b"), allowMissingColumns=True).groupBy(*key, "view", "dim")
            .agg(*(F.max(f"{c}_{p}").alias(f"{c}_{p}") for p in "ab" for c in (*_SELECTION, "has"))))
    whole = F.col("has_a") & F.col("has_b")
    meet = (F.when(F.col("inc_a").isNull(), F.col("inc_b")).when(F.col("inc_b").isNull(), F.col("inc_a"))
            .otherwise(F.array_sort(F.array_intersect("inc_a", "inc_b"))))
    both = cut(both.withColumns({
        "lo_m": F.when(whole, F.greatest("lo_a", "lo_b")), "hi_m": F.when(whole, F.least("hi_a", "hi_b")), "inc_m": F.when(whole, meet),
        "exc_m": F.when(whole, F.array_sort(F.array_union("exc_a", "exc_b")))}))
    of = lambda p: both.where(whole if p == "m" else F.col(f"has_{p}")).select("view", "dim", *(F.col(f"{c}_{p}").alias(c) for c in _SELECTION))
    sizes = cut(selection_sizes(of("a").unionByName(of("b")).unionByName(of("m")), marginal_table))
    for p in "abm":
        named = sizes.select("view", "dim", F.col("key").alias(f"key_{p}"), F.col("size").alias(f"size_{p}"))
        both = both.withColumn(f"key_{p}", F.when(whole if p == "m" else F.col(f"has_{p}"), _selection_key(*(f"{c}_{p}" for c in _SELECTION)))).join(
            named, ["view", "dim", f"key_{p}"], "left")
    totals = marginal_table.groupBy("view", "dim").agg(F.sum("n_persons").alias("total"))
    # a side without a filter selects everything
    part = (F.when(F.col("has_a").isNull(), F.col("total") - F.col("size_b")).when(F.col("has_b").isNull(), F.col("total") - F.col("size_a"))
            .otherwise(F.col("size_a") + F.col("size_b") - 2 * F.col("size_m")))
    summed = both.join(totals, ["view", "dim"]).groupBy(*key).agg(F.sum(part).alias("bound"))
    return pairs.join(summed, key, "left").select(
        *pairs.columns, F.coalesce("bound", F.lit(0)).cast("bigint").alias("bound"))


class CohortIndex:
    """Cohorts of one view as sets of dimension combinations.

    ``persons``: combo, person (distinct).  ``sizes``: combo, n_persons.
    ``members``: combo, cohort_id.  All three are read many times, so they are
    written out once.
    """

    def __init__(self, ws: Workspace, view: str, cohorts: DataFrame, dims):
        kinds = {d: k for d, k in ws.study.view(view).filter_kinds().items() if d in set(dims)}
        rows = combination_persons(ws, view, sorted(kinds))
        combo = F.to_json(F.struct(*sorted(kinds)), {"ignoreNullFields": "false"})
        rows = cut(rows.withColumn("combo", combo))
        self.persons = rows.select("combo", PERSON)
        self.sizes = cut(rows.groupBy("combo", *sorted(kinds)).agg(F.count(F.lit(1)).alias("n_persons")))
        distinct = self.sizes.select("combo", *sorted(kinds))
        values = long_values(distinct, view, kinds, ("combo",))
        mine = cohorts.where(F.col("view") == view)
        counts = cut(values.groupBy("view", "dim", "kind", "value").agg(F.count(F.lit(1)).alias("combos")))
        hits = cut(selected_values(mine, counts).where("chosen").select("cohort_id", "dim", "value"))
        # each cohort is looked up by its most selective filter, the others are
        # then evaluated on the combinations found; no filter means every combination
        weight = (mine.select("cohort_id", F.explode("predicates.column").alias("dim")).distinct()
                  .join(hits.join(counts.select("dim", "value", "combos"), ["dim", "value"])
                        .groupBy("cohort_id", "dim").agg(F.sum("combos").alias("w")), ["cohort_id", "dim"], "left"))
        anchor = weight.groupBy("cohort_id").agg(F.min_by("dim", F.coalesce("w", F.lit(0))).alias("dim"))
        doors = hits.join(anchor, ["cohort_id", "dim"], "left_semi").unionByName(
            mine.where(F.size("predicates") == 0).select(
                "cohort_id", F.lit(ALL_DIM).alias("dim"), F.lit(ALL_VALUE).alias("value")))
        doors = doors.join(mine.select("cohort_id", "predicates"), "cohort_id")
        held = F.create_map(*(x for d in sorted(kinds) for x in (F.lit(d), F.col(d).cast("string"))))
        spots = distinct.select("combo", held.alias("held"))
        spots = spots.select("combo", "held", F.explode("held").alias("dim", "value")).unionByName(
            spots.select("combo", "held", F.lit(ALL_DIM).alias("dim"), F.lit(ALL_VALUE).alias("value")))
        kind_of = F.create_map(*(F.lit(x) for d, k in sorted(kinds.items()) for x in (d, k)))
        holds = F.forall("predicates", lambda p: matches(
            F.element_at(F.col("held"), p["column"]), F.element_at(kind_of, p["column"]), p["op"], p["values"]))
        self.members = cut(spots.join(doors, ["dim", "value"]).where(holds).select("combo", "cohort_id"))
        self.sizes = self.sizes.select("combo", "n_persons")

    def cohort_sizes(self, enough: int) -> DataFrame:
        """Distinct persons per cohort; from ``enough`` on a lower bound may stand.

        A combination's persons all belong to the cohort, so one that holds
        ``enough`` settles the matter; persons are looked up for the other cohorts only.
        """
        most = cut(self.members.join(self.sizes, "combo").groupBy("cohort_id").agg(F.max("n_persons").alias("n_persons")))
        open_ = most.where(F.col("n_persons") < enough).select("cohort_id")
        exact = (self.members.join(open_, "cohort_id", "left_semi").join(self.persons, "combo").select("cohort_id", PERSON)
                 .distinct().groupBy("cohort_id").agg(F.count(F.lit(1)).alias("n_persons")))
        return most.where(F.col("n_persons") >= enough).unionByName(exact)

    def classes(self, cohorts: DataFrame) -> DataFrame:
        """cohort_id, class_id: cohorts of the same combinations are one class, named by the least of them.

        Every combination has persons, so two cohorts select the same rows exactly if they
        are one class; they are compared by two 64-bit sums over their combinations.
        """
        marks = (self.members.join(cohorts.select("cohort_id"), "cohort_id", "left_semi").groupBy("cohort_id")
                 .agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("combo")).alias("x"),
                      F.bit_xor(F.xxhash64("combo", F.lit(1))).alias("y")))
        named = marks.groupBy("k", "x", "y").agg(F.min("cohort_id").alias("class_id"))
        return cut(marks.join(named, ["k", "x", "y"]).select("cohort_id", "class_id"))

    def releasable(self, delta: int, min_persons: int) -> DataFrame:
        """Cohorts of at least ``min_persons``; sizes are exact below 2 · ``delta``."""
        return cut(self.cohort_sizes(max(2 * delta, min_persons)).where(F.col("n_persons") >= min_persons))


def exact_differences(index: CohortIndex, pairs: DataFrame, delta: int) -> DataFrame:
    """Persons behind rows exactly one cohort of a pair selects, where few.

    Returns cohort_a, cohort_b, n_persons for pairs below ``delta``.  A pair is
    dropped at once when one differing combination alone holds ``delta``
    persons, so persons are only looked up in small combinations.
    """
    key = ["cohort_a", "cohort_b"]
    side = lambda p: pairs.select(*key).join(
        index.members.withColumnRenamed("cohort_id", f"cohort_{p}"), f"cohort_{p}").select(
        *key, "combo", F.lit(1 if p == "a" else -1).alias("side"))
    odd = cut(side("a").unionByName(side("b")).groupBy(*key, "combo")
              .agg(F.sum("side").alias("side")).where("side <> 0").drop("side"))
    sized = odd.join(index.sizes, "combo")
    near = sized.groupBy(*key).agg(F.max("n_persons").alias("most")).where(F.col("most") < delta)
    small = index.sizes.where(F.col("n_persons") < delta).select("combo")
    few = (odd.join(near.select(*key), key, "left_semi")
           .join(index.persons.join(small, "combo", "left_semi"), "combo")
           .select(*key, PERSON).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_persons")))
    none = (pairs.select(*key).join(odd.select(*key).distinct(), key, "left_anti")
            .withColumn("n_persons", F.lit(0).cast("bigint")))
    return few.unionByName(none).where(F.col("n_persons") < delta)


def small_pairs(index: CohortIndex, sizes: DataFrame, delta: int) -> DataFrame:
    """Pairs that may differ over fewer than ``delta`` persons and of which one has fewer.

    The other one then has fewer than 2 · ``delta``.  Such a pair shares a person,
    or its sizes add up to less than ``delta``: the first kind meets on persons, the
    second on sizes.
    """
    compact = sizes.where(F.col("n_persons") < 2 * delta)
    tokens = cut(index.members.join(compact, "cohort_id").join(index.persons, "combo")
                 .select("cohort_id", F.col("n_persons").alias("n"), PERSON).distinct())
    side = lambda df, p: df.withColumnsRenamed({"cohort_id": f"cohort_{p}", "n": f"n_{p}"})
    sharing = (side(tokens, "a").join(side(tokens, "b"), PERSON)
               .where((F.col("cohort_a") < F.col("cohort_b")) & (F.least("n_a", "n_b") < delta)).select("cohort_a", "cohort_b"))
    small = sizes.where(F.col("n_persons") < delta - 1).select("cohort_id", F.col("n_persons").alias("n"))
    fitting = side(small, "a").withColumn("n_b", F.explode(F.sequence(F.lit(1), F.lit(delta - 1) - F.col("n_a"))))
    apart = fitting.join(side(small, "b").withColumn("n_b", F.col("n_b")), "n_b").where("cohort_a < cohort_b").select(
        "cohort_a", "cohort_b")
    return sharing.unionByName(apart).distinct()


def candidate_pairs(index: CohortIndex, sizes: DataFrame, delta: int, least: int = 1) -> DataFrame:
    """Pairs of cohorts that may differ over fewer than ``delta`` persons.

    ``sizes``: cohort_id, n_persons.  Complete by counting: persons fall into
    2·delta slices, so such a pair agrees on more than delta slices.  Cohorts are
    matched on equal slice digests.  If all agreeing slices are empty, both cohorts
    touch fewer than delta slices; those confined cohorts are matched on their
    ``delta`` rarest persons, of which two of at least delta persons must share one.
    Pairs with a cohort of fewer than delta persons come from :func:`small_pairs`;
    there are none if every cohort holds ``least`` and that is delta or more.
    """
    cohort_ids = sizes.where(F.col("n_persons") >= delta).select("cohort_id")
    slices = 2 * delta
    place = F.pmod(F.xxhash64(PERSON), F.lit(slices))
    digests = index.persons.groupBy("combo", place.alias("slice")).agg(
        F.bit_xor(F.xxhash64("combo", PERSON)).alias("digest"), F.count(F.lit(1)).alias("k"))
    mine = index.members.join(cohort_ids.select("cohort_id"), "cohort_id", "left_semi")
    marks = cut(mine.join(digests, "combo").groupBy("cohort_id", "slice")
                .agg(F.bit_xor("digest").alias("digest"), F.sum("k").alias("k")))
    pair = lambda left, right, on: (
        left.withColumnRenamed("cohort_id", "cohort_a")
        .join(right.withColumnRenamed("cohort_id", "cohort_b"), on)
        .where("cohort_a < cohort_b").select("cohort_a", "cohort_b"))
    found = pair(marks, marks, ["slice", "digest", "k"])
    tiny = marks.groupBy("cohort_id").agg(F.count(F.lit(1)).alias("s")).where(F.col("s") < delta)
    tokens = cut(mine.join(tiny, "cohort_id", "left_semi").join(index.persons, "combo")
                 .select("cohort_id", PERSON).distinct())
    rarity = tokens.groupBy(PERSON).agg(F.count(F.lit(1)).alias("f"))
    order = W.partitionBy("cohort_id").orderBy("f", PERSON)
    prefix = (tokens.join(rarity, PERSON).withColumn("r", F.row_number().over(order))
              .where(F.col("r") <= delta).select("cohort_id", PERSON))
    large = found.unionByName(pair(prefix, prefix, [PERSON]))
    if least < delta:
        large = large.unionByName(small_pairs(index, sizes, delta))
    return cut(large.distinct())


def filtered_dims(cohorts: DataFrame, ws: Workspace, view: str) -> list[str]:
    """Which of a view's dimensions the cohorts filter (a bounded schema-level list)."""
    kinds = ws.study.view(view).filter_kinds()
    row = cohorts.where(F.col("view") == view).agg(*(
        F.max(F.array_contains("predicates.column", d)).alias(d) for d in sorted(kinds))).first()
    return [d for d in sorted(kinds) if row[d]]


def close_classes(ws: Workspace, view: str, cohorts: DataFrame, delta: int,
                  min_persons: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes of equal releasable cohorts, and the close pairs of classes.

    cohort_id, class_id; and class_a, class_b, n_persons for classes that differ over
    fewer than ``delta`` persons.  Cohorts of one class differ over nobody.  However many
    cohorts select the same rows, they are compared once.
    """
    min_persons = delta if min_persons is None else min_persons
    index = CohortIndex(ws, view, cohorts, filtered_dims(cohorts, ws, view))
    return _close_classes(index, index.releasable(delta, min_persons), delta, min_persons)


def _close_classes(index: CohortIndex, sizes: DataFrame, delta: int, min_persons: int) -> tuple[DataFrame, DataFrame]:
    classes = index.classes(sizes)
    heads = sizes.join(classes.where("cohort_id = class_id").select("cohort_id"), "cohort_id", "left_semi")
    pairs = exact_differences(index, candidate_pairs(index, heads, delta, min_persons), delta)
    return classes, pairs.withColumnsRenamed({"cohort_a": "class_a", "cohort_b": "class_b"})


def expand_classes(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """cohort_a, cohort_b, n_persons of every pair of cohorts behind classes and their close pairs."""
    one = classes.select(F.col("cohort_id").alias("one"), F.col("class_id").alias("class_a"))
    two = classes.select(F.col("cohort_id").alias("two"), F.col("class_id").alias("class_b"))
    within = one.join(two, one.class_a == two.class_b).where("one < two").select(
        "one", "two", F.lit(0).cast("bigint").alias("n_persons"))
    across = pairs.join(one, "class_a").join(two, "class_b").select("one", "two", "n_persons")
    return within.unionByName(across).select(
        F.least("one", "two").alias("cohort_a"), F.greatest("one", "two").alias("cohort_b"), "n_persons")


def close_pairs(ws: Workspace, view: str, cohorts: DataFrame, delta: int,
                min_persons: int | None = None) -> DataFrame:
    """All pairs of releasable cohorts of one view that differ over fewer than
    ``delta`` persons: cohort_a, cohort_b, n_persons.

    A cohort is releasable from ``min_persons`` on; without it, one bound serves
    both purposes.  Where many cohorts are equal, :func:`close_classes` says the same in
    rows that do not multiply.
    """
    return expand_classes(*close_classes(ws, view, cohorts, delta, min_persons))


def enumerated_cohorts(ws: Workspace, view: str, widest: int = 2) -> DataFrame:
    """Every cohort of up to ``widest`` equalities over the declared category lists of a view.

    cohort_id, view, predicates.  Its size follows from the study's declarations alone.
    """
    kinds = ws.study.view(view).dims
    listed = {d: ws.study.domain(d) for d in sorted(kinds) if kinds[d] == "cat" and ws.study.domain(d)}
    rows = []
    for k in range(widest + 1):
        for dims in combinations(listed, k):
            for values in product(*(listed[d] for d in dims)):
                rows.append(("&".join(f"{d}={v}" for d, v in zip(dims, values)), view,
                             [(d, "==", [str(v)]) for d, v in zip(dims, values)]))
    return ws.spark(view).createDataFrame(
        rows, "cohort_id string, view string, predicates array<struct<column:string,op:string,values:array<string>>>")


def survey(ws: Workspace, view: str, cohorts: DataFrame, marginal_table: DataFrame,
           delta: int, min_persons: int | None = None) -> DataFrame:
    """Over all pairs of releasable cohorts: how many each check denies.

    Far pairs are only counted, never listed.
    """
    min_persons = delta if min_persons is None else min_persons
    index = CohortIndex(ws, view, cohorts, filtered_dims(cohorts, ws, view))
    large = index.releasable(delta, min_persons)
    close = cut(expand_classes(*_close_classes(index, large, delta, min_persons)))
    bounds = marginal_bounds(close, cohorts, marginal_table)
    total = large.agg(F.count(F.lit(1)).alias("n")).scalar()
    cheap = F.coalesce(F.sum(F.when(F.col("bound") < delta, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return (bounds.agg(cheap.alias("marginal_denies"), F.count(F.lit(1)).alias("denied"))
            .withColumn("cohorts", total)
            .select("cohorts", (F.col("cohorts") * (F.col("cohorts") - 1) / 2).cast("bigint").alias("pairs"),
                    "marginal_denies", (F.col("denied") - F.col("marginal_denies")).alias("exact_only")))


def cross_view_differences(ws: Workspace, quantity: str, pairs: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Persons whose contribution differs, for listed pairs on two views.

    ``pairs``: cohort_a, cohort_b.  Each cohort is summed per person once, both
    sides of a pair are added with opposite sign.
    """
    parts = []
    for view, column in sorted(ws.study.quantities[quantity].items()):
        dims = filtered_dims(cohorts, ws, view)
        index = CohortIndex(ws, view, cohorts, dims)
        sums = ws.per_person(view, dims, (), (), lambda c: {"_s": c(column)})
        combo = F.to_json(F.struct(*sorted(dims)), {"ignoreNullFields": "false"})
        parts.append(index.members.join(sums.withColumn("combo", combo), "combo")
                     .groupBy("cohort_id", PERSON)
                     .agg(F.sum("_s").alias("_s")))
    amount = cut(reduce(DataFrame.unionByName, parts))
    side = lambda p, sign: pairs.select("cohort_a", "cohort_b").join(
        amount.withColumnRenamed("cohort_id", f"cohort_{p}"), f"cohort_{p}").select(
        "cohort_a", "cohort_b", PERSON, (F.coalesce("_s", F.lit(0)) * sign).alias("_s"))
    gaps = (side("a", 1).unionByName(side("b", -1)).groupBy("cohort_a", "cohort_b", PERSON)
            .agg(F.sum("_s").alias("_d")).where(F.abs("_d") > 1e-6)
            .groupBy("cohort_a", "cohort_b").agg(F.count(F.lit(1)).alias("n_persons")))
    return pairs.join(gaps, ["cohort_a", "cohort_b"], "left").select(
        *pairs.columns, F.coalesce("n_persons", F.lit(0)).alias("n_persons"))
