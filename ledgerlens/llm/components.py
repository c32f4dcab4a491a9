"""Connected components of an edge table, by smallest labels and pointer jumping; every step is written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, component): component is the smallest node that can be reached.

    Nodes without edges don't appear.  Nulls and loops are ignored; no edges give an empty result.  Labels spread over
    edges and are then replaced by their own labels, so the number of rounds grows with the logarithm of path lengths
    in the usual case.  Nothing but a count of changed labels reaches the driver.
    """
    both = edges.filter("a is not null and b is not null and a <> b").select("a", "b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    while True:
        of = labels.withColumnRenamed("node", "b").withColumnRenamed("component", "other")
        near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = materialize(spread.join(up, "component", "left").select("node", "was", F.least("component", F.coalesce("up", "component")).alias("component")))
        labels = new.select("node", "component")
        if new.filter("was <> component").limit(1).count() == 0:
            return labels
