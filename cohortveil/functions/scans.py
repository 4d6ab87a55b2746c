"""Ordered scans over whole tables without putting a group into one task.

Rows are range-partitioned on (group, order), the partition number is frozen
by writing the rows out, and every scan is finished with per-partition offsets:
a group of any size is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def _ranged(df: DataFrame, group, order) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(c) if isinstance(c, str) else c for c in [*group, *order]]
    return cut(df.repartitionByRange(n, *columns).withColumn("_part", F.spark_partition_id()))


def _merge(parts: DataFrame, summary: DataFrame, group) -> DataFrame:
    right = summary.select(*(F.col(g).alias("r_" + g) for g in group),
                           F.col("_part").alias("r_part"), "_before")
    on = [F.col(g).eqNullSafe(F.col("r_" + g)) for g in group]
    return parts.join(right, [*on, F.col("_part") == F.col("r_part")]).drop(
        "r_part", *("r_" + g for g in group))


def running_sum(df: DataFrame, group, order, value: Column, out: str = "running") -> DataFrame:
    """Inclusive running sum of ``value`` per group in the given order."""
    group, order = list(group), list(order)
    parts = _ranged(df.withColumn("_v", value), group, order)
    # one row per (group, partition): at most as many rows per group as partitions
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    summary = (parts.groupBy(*group, "_part").agg(F.sum("_v").alias("_t"))
               .withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0))))
    inside = W.partitionBy(*group, "_part").orderBy(*order).rowsBetween(
        W.unboundedPreceding, W.currentRow)
    return (_merge(parts, summary, group)
            .withColumn(out, F.col("_before") + F.sum("_v").over(inside))
            .drop("_v", "_part", "_before"))


def rank_rows(df: DataFrame, order, group=(), out: str = "rank") -> DataFrame:
    """Row number per group in the given order."""
    return running_sum(df, group, order, F.lit(1), out).withColumn(out, F.col(out).cast("bigint"))


def following_min(df: DataFrame, order, value: Column, out: str) -> DataFrame:
    """Minimum of ``value`` over this row and all later ones."""
    order = list(order)
    parts = _ranged(df.withColumn("_v", value), (), order)
    after = W.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)
    summary = (parts.groupBy("_part").agg(F.min("_v").alias("_t"))
               .withColumn("_before", F.min("_t").over(after)))
    back = [F.desc(c) for c in order]
    inside = W.partitionBy("_part").orderBy(*back).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (_merge(parts, summary, ())
            .withColumn(out, F.least("_before", F.min("_v").over(inside)))
            .drop("_v", "_part", "_before"))
