"""Bounded training samples: the first rows of each class in an order by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

#: Rows of (class, id) that may be broadcast; more of them are joined by shuffle.
BROADCAST_ROWS = 100_000
_RANGE = 1 << 52


def first_by_hash(rows: DataFrame, kind: str, limit: Column) -> DataFrame:
    """(kind, id): at most ``limit`` distinct ids of each kind, those of least hash.

    A class of any size first drops the hashes that cannot be among the first
    ``limit``, so what meets in the ranking is bounded however many rows there are.
    """
    ids = rows.select(kind, "id").distinct()
    sizes = ids.groupBy(kind).agg(F.count("*").alias("size"))
    place = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(_RANGE))
    # half as many again as wanted: the share that comes out short of the limit is negligible
    near = ids.join(sizes, kind).where(place / _RANGE <= (1.5 * limit + 50) / F.col("size"))
    order = W.partitionBy(kind).orderBy(place, "id")
    return cut(near.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= limit).select(kind, "id"))


def texts_of(rows: DataFrame, chosen: DataFrame, kind: str) -> DataFrame:
    """(kind, id, text) of the chosen ids, one text per id (of several, the least), in one partition."""
    few = chosen.count() <= BROADCAST_ROWS
    return (rows.join(F.broadcast(chosen) if few else chosen, [c for c in (kind, "id") if c in rows.columns])
            .groupBy(kind, "id").agg(F.min("text").alias("text")).repartition(1))
