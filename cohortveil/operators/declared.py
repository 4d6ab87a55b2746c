"""Values that no declaration accounts for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..study import Study


def allowed(study: Study, column: str, ranges: dict) -> Column | None:
    """What a present value must satisfy: its declared domain, its range, or nothing.

    ``ranges`` has (low, high) by column; a banded column lies between its outer edges.
    """
    domain = study.domain(column)
    if domain is not None:
        return F.col(column).isin(list(domain))
    if column in ranges:
        low, high = ranges[column]
        return F.col(column).between(low, high)
    return None


def violations(tables: dict[str, DataFrame], study: Study, ranges: dict | None = None) -> DataFrame:
    """One row per declared column: table, column, nulls, outside.

    One aggregate per table, combined before its shuffle.
    """
    out = []
    for table, columns in study.tables.items():
        sums = []
        for column in columns:
            ok = allowed(study, column, ranges or {})
            value = F.col(column)
            outside = F.lit(False) if ok is None else value.isNotNull() & ~ok
            sums += [F.count_if(value.isNull()).alias(f"n_{column}"), F.count_if(outside).alias(f"o_{column}")]
        found = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("nulls"), F.col(f"o_{c}").alias("outside"))
                          for c in columns))
        out.append(tables[table].agg(*sums).select(F.lit(table).alias("table"), F.inline(found)))
    return reduce(DataFrame.unionByName, out)
