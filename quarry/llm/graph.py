"""Connected components of a table of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) for every node that ``links`` (a, b) name.

    Each round takes the smallest label among the neighbours, then the label of that label,
    so long chains halve. Every round is written to the shared folder.
    """
    both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("j"), F.col("component").alias("far"))
        after = lower.join(jump, F.col("low") == F.col("j"), "left").select("node", "old", F.least("low", F.coalesce("far", "low")).alias("component"))
        after = materialise(after, "labels")
        moved = after.filter("old <> component").limit(1).count()
        labels = after.select("node", "component")
        if not moved:
            return labels
