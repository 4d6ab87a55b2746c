"""Connected components of an edge table, by label propagation with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (columns a, b); the label is the component's least node.

    Every round takes the least label among a node and its neighbours, then
    follows labels once more; rounds stop when nothing changes.  Tables are
    written between rounds, and minima are combined before each shuffle, so a node
    with very many neighbours costs no more than its edges.  Nulls and loops are
    left out; an empty table gives an empty one.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = cut(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m")))
        step = labels.join(near, labels.node == near.a).select(
            "node", F.col("label").alias("old"), F.least("label", "m").alias("mid"))
        step = cut(step)
        jump = step.select(F.col("node").alias("via"), F.col("mid").alias("label"))
        labels = cut(step.join(jump, step.mid == jump.via).select("node", "old", F.least("mid", "label").alias("label")))
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")
