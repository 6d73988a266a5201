"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybook.sources.scratch import discard, stage


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable by the links (a, b), for every node that has one.

    Each round takes the smallest label among the neighbours and then the
    label's own label, so that distances about double; labels are written
    after every round. Rows are only ever aggregated by node, with partial
    aggregation before the shuffle. All joins are merge joins: there are two in each round,
    and as many broadcast tables would wait in the driver's memory. No links: no rows.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.hint("merge"), both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        low = labels.join(near.hint("merge"), labels.node == near.a).select("node", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        after = stage(low.join(jump.hint("merge"), "low").select("node", F.least("low", "far").alias("component"), (F.least("low", "far") != F.col("component")).alias("moved")), "labels")
        still = after.filter("moved").isEmpty()
        discard(labels)
        labels = after.select("node", "component")
        if still:
            discard(both)
            return labels
