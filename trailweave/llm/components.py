"""Connected components of a table of links, by least labels and jumps.

Each round gives every node the label of its label, then the least label among
itself and its neighbours, and gives the same to the node that it had as label.
So whole trees of labels hook onto smaller ones: stars settle in one round and
long paths in rounds that grow with the logarithm of their length. Labels are written to the shared folder after
each half of a round, so that both sides of a join come from files and a hub's
rows can be split among tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(links: DataFrame) -> DataFrame:
    """Links (a, b) of any orderable type to (node, component): the smallest node reachable. Nodes without a link to another are left out. The tables of each round go as the next is there."""
    scratch = Scratch(links.sparkSession, "components")
    edges = links.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct()
    edges = scratch.keep(edges)
    labels = scratch.keep(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).withColumn("component", F.least("node", "component")))
    while not labels.isEmpty():
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        jumped = scratch.keep(labels.join(far, "component").select("node", F.col("far").alias("component")))
        near = edges.join(jumped.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        told = scratch.keep(jumped.join(near, "node"))
        hook = told.groupBy(F.col("component").alias("node")).agg(F.min("near").alias("hook"))
        least = F.least("component", "near", F.coalesce("hook", "component"))
        after = scratch.keep(told.join(hook, "node", "left").select("node", least.alias("component"), (least < F.col("component")).alias("moved")))
        moved = not after.where("moved").limit(1).isEmpty()
        if not moved:
            # Every edge joins equal labels, but a label may still point to another: jump until none does.
            same = scratch.keep(jumped.join(jumped.select(F.col("node").alias("component"), F.col("component").alias("far")), "component").select("node", F.col("far").alias("component"), (F.col("far") < F.col("component")).alias("moved")))
            if same.where("moved").limit(1).isEmpty():
                scratch.only(same)
                return same.select("node", "component")
            after = same
        labels = after.drop("moved")
        scratch.only(edges, after)
    return labels
