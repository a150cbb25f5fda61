"""Connected components of a graph of links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node that can be reached.

    Each round gives a node the least label among its neighbours and then the label of that label, so labels
    travel twice as far in each round.  Every round's labels are written to the shared folder, where only the last stay.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        least = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("further"))
        after = stored(
            least.join(jump, least.component == jump["at"]).select("node", "old", F.least("component", "further").alias("component")), "labels",
        )
        discard(labels)
        labels = after
        if after.filter("old <> component").isEmpty():
            discard(both)
            return labels.select("node", "component")
