"""Reading exported audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit_since(rows: DataFrame, cutoff, parsed: dict[str, str]) -> DataFrame:
    """Rows at or after ``cutoff`` whose JSON columns all parse.

    ``parsed`` maps a text column to the type it holds.  A row with unreadable
    JSON is dropped; a missing value stays missing.
    """
    out = rows if cutoff is None else rows.where(F.col("ts") >= F.lit(cutoff))
    for column, kind in parsed.items():
        value = F.from_json(column, kind)
        out = out.withColumn("_v", value).where(
            F.col(column).isNull() | F.coalesce(F.to_json("_v") != "{}", F.lit(False)))
        out = out.withColumn(column, F.col("_v")).drop("_v")
    return out
