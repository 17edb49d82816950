"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import step


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of the edges (long ids, nulls and loops ignored); the nodes of a component, and no others, share a label, which is one of them.

    In a round each node points to the smallest id within two steps, and edges then join what their ends point to; those within one
    node vanish, so stars and groups of near copies take one round, and others shrink by a large factor. Only a flag reaches the driver;
    joins are by sort and merge, as broadcasts round after round would fill the driver. The labels read the rounds' tables (see step).
    """
    rest = step(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct())
    labels = None
    while not rest.isEmpty():
        both = rest.select(F.col("a").alias("node"), F.col("b").alias("to")).union(rest.select(F.col("b").alias("node"), F.col("a").alias("to")))
        near = step(both.groupBy("node").agg(F.min("to").alias("m")).select("node", F.least("node", "m").alias("m")))  # written, so that the join below is one whose hot nodes Spark splits
        far = both.join(near.withColumnRenamed("node", "to").hint("merge"), "to").groupBy("node").agg(F.min("m").alias("next"))
        to = step(far.select("node", F.least("node", "next").alias("next")))
        hop = to.hint("merge")
        left = rest.join(hop.withColumnsRenamed({"node": "a", "next": "x"}), "a").join(hop.withColumnsRenamed({"node": "b", "next": "y"}), "b")
        rest = step(left.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        if labels is None:
            labels = to.withColumnRenamed("next", "label")
        else:
            labels = labels.join(hop.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return edges.sparkSession.createDataFrame([], "node long, label long") if labels is None else labels
