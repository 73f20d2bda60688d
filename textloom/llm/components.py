"""Connected components of an edge table by neighbour minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: long); component is the smallest node reachable.

    Each round takes the least label among neighbours, then follows labels one step, so chains shorten by half
    at least. Rounds end at written tables; only a count of changed labels reaches the driver.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        step = written(step)
        jump = step.select(F.col("node").alias("at"), F.col("component").alias("further"))
        labels = written(step.join(jump, step["component"] == jump["at"]).select("node", F.col("further").alias("component"), (F.col("further") != F.col("was")).alias("moved")))
        if not labels.where("moved").limit(1).count():
            return labels.select("node", "component")
        labels = labels.drop("moved")
