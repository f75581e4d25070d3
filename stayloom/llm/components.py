"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayloom.session import LoopState, cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Labels fall to the smallest label among neighbours, then to the label of that label, until none changes; every round is
    written to the shared folder. Minima are combined before the shuffle, so a node with very many links is no hot group.
    """
    links = links.where("a <> b")
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").distinct(), "links")
    state = LoopState("labels")
    labels = state.advance(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        labels = state.advance(lower.join(jump, "component", "left").select(
            "node", "was", F.least("component", F.coalesce("far", "component")).alias("component")))
        if labels.where("component <> was").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
