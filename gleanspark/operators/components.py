"""Connected components of a graph that is given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import removed, unsent, written

#: The planner may broadcast labels up to so many nodes.
FEW = 500_000


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b.  Of every node that has an edge to another one: node, root (the least node it can reach).

    Each round takes the least label among the neighbours (sums that combine before the shuffle, so a hub's
    edges don't meet in one task) and then the label's own label, so labels travel in doubling steps.
    Each round is a table in the shared folder, which cuts lineage; the round before goes.  Labels of one component take hardly a byte
    in such a table, so by its size any number of them would be broadcast.
    """
    spark, apart = edges.sparkSession, edges.where("a <> b").select("a", "b")
    both, at_both = written(apart.union(apart.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, at = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    side = (lambda df: df) if labels.count() <= FEW else unsent
    while True:
        near = both.join(side(labels.select(F.col("node").alias("b"), "root")), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(side(near), "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        new, at_new = written(step.join(side(jump), "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("new"), F.col("root")), "labels")
        changed = new.agg(F.max((F.col("new") != F.col("root")).cast("int"))).first()[0]
        removed(spark, [at])
        labels, at = new.select("node", F.col("new").alias("root")), at_new
        if not changed:
            removed(spark, [at_both])
            return labels
