"""Connected components by hooking and pointer jumping, all in joins and aggregates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodquarry.llm.tables import keep


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node that each node of `links` reaches. Nodes without a link are not listed.

    A round hooks every node to its smallest smaller neighbour, flattens these trees by pointer jumping and replaces the ends
    of all links by roots; what still links two roots goes on. Roots at least halve, so the rounds are logarithmic. Links are
    distinct pairs in written tables, so a hot node's rows can be split in the joins, and its minimum is pre-aggregated.
    """
    ends = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct()
    ends = keep(ends, "links")
    labels = None
    while not ends.isEmpty():
        tree = keep(ends.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), "hooks")
        while True:
            up = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = keep(tree.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), "above"), "jumps")
            tree = jumped.drop("above")
            if jumped.filter("above is not null").isEmpty():
                break
        if labels is None:
            below = ends.select(F.col("lo").alias("node")).distinct().join(tree, "node", "left_anti")
            labels = keep(tree.unionByName(below.withColumn("root", F.col("node"))), "labels")
        else:
            up = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
            labels = keep(labels.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "labels")
        hi, lo = tree.toDF("hi", "new_hi"), tree.toDF("lo", "new_lo")
        moved = ends.join(hi, "hi", "left").join(lo, "lo", "left").select(
            F.coalesce("new_hi", "hi").alias("x"), F.coalesce("new_lo", "lo").alias("y")
        )
        ends = keep(moved.filter("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "links")
    if labels is None:
        return ends.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return labels
