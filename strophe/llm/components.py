"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for the nodes of links(a, b).

    Every round hands each node the smallest component among its neighbours and then follows the component's own
    label, so that chains halve; sums and joins only, written after each round.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), "labels")
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("of_b"))
        near = both.join(of_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("of_b").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("further"))
        after = materialize(lower.join(jump, "to").select("node", "was", F.least("to", "further").alias("component")), "labels")
        labels = after.select("node", "component")
        if after.where("was <> component").isEmpty():
            return labels
