"""Filters as Column expressions and as operations on tables of predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..specs import Filter

ALL_DIM, ALL_VALUE = "*", "*"


def condition(f: Filter, column=F.col) -> Column:
    c = column(f.column)
    if f.op == "in":
        return c.isin(list(f.value))
    return {
        "==": lambda: c == F.lit(f.value), "!=": lambda: c != F.lit(f.value),
        "<": lambda: c < F.lit(f.value), "<=": lambda: c <= F.lit(f.value),
        ">": lambda: c > F.lit(f.value), ">=": lambda: c >= F.lit(f.value),
    }[f.op]()


def conjunction(filters, column=F.col) -> Column:
    """All filters together; no filters select every row."""
    return reduce(lambda a, b: a & b, (condition(f, column) for f in filters), F.lit(True))


def not_null(columns, column=F.col) -> Column:
    return reduce(lambda a, b: a & b, (column(c).isNotNull() for c in columns), F.lit(True))


def normal_predicates(predicates: Column) -> Column:
    """Order-free form of an array of (column, op, values) structs: values are
    deduplicated and sorted, a one-value ``in`` becomes ``==``, then the array
    itself is deduplicated and sorted."""

    def tidy(p):
        values = F.array_sort(F.array_distinct(p["values"]))
        op = F.when((p["op"] == "in") & (F.size(values) == 1), F.lit("==")).otherwise(p["op"])
        return F.struct(p["column"].alias("column"), op.alias("op"), values.alias("values"))

    return F.array_sort(F.array_distinct(F.transform(predicates, tidy)))


def matches(value: Column, kind: Column, op: Column, values: Column) -> Column:
    """Whether a text ``value`` satisfies one predicate; NULL satisfies none."""
    number, bound = value.try_cast("bigint"), F.element_at(values, 1).try_cast("bigint")
    first = F.element_at(values, 1)
    is_int = kind == "int"
    ordered = (F.when(op == "<", number < bound).when(op == "<=", number <= bound)
               .when(op == ">", number > bound).when(op == ">=", number >= bound))
    verdict = (F.when(op == "==", F.when(is_int, number == bound).otherwise(value == first))
               .when(op == "!=", F.when(is_int, number != bound).otherwise(value != first))
               .when(op == "in", F.array_contains(values, value))
               .when(is_int, ordered))
    return F.coalesce(verdict, F.lit(False))


def selected_values(cohorts: DataFrame, values: DataFrame) -> DataFrame:
    """For every cohort and every dimension it filters: which values it selects.

    ``cohorts``: cohort_id, view, predicates.  ``values``: view, dim, kind, value
    (value as text, NULL for a missing one).  Several predicates on one dimension
    must all hold.  Output: cohort_id, view, dim, value, chosen.
    """
    wanted = cohorts.select("cohort_id", "view", F.explode("predicates").alias("p")).select(
        "cohort_id", "view", F.col("p.column").alias("dim"),
        F.col("p.op").alias("op"), F.col("p.values").alias("values"))
    return (values.select("view", "dim", "kind", "value")
            .join(wanted, ["view", "dim"])
            .withColumn("ok", matches(F.col("value"), F.col("kind"), F.col("op"), F.col("values")))
            .groupBy("cohort_id", "view", "dim", "value")
            .agg(F.min("ok").alias("chosen")))
