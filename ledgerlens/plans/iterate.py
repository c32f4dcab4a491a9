"""Paths by repeated joins: a bounded number of equi-joins, each pruned by its step predicate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixpoint import checkpointed


def iterate_paths(edges: DataFrame, max_hops: int, step: Callable[[Column, Column, Column, Column], Column], within: int, distinct: bool = True) -> Iterator[DataFrame]:
    """Paths of 1, 2, ... max_hops edges over (src, dst, amt, t, rid), as (first, last, nodes, amts, times, rids).

    `step` gets the last amount, the last time, the next amount and the next time.  With `distinct` no node comes twice.
    A next edge comes 0 to `within` seconds after the last one, which the step predicate may narrow.  Times fall into
    buckets of that length and are part of the join's key, so a hub's arrivals meet only the departures of their own
    bucket and the one after; edges stand in both buckets, so the longer paths are shuffled once.  Paths that can't go on
    never reach the next shuffle.  Each length is written, so that none is computed more than once.
    """
    bucket = lambda t: F.floor(t / within)
    paths = edges.select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("nodes"), F.array("amt").alias("amts"), F.array("t").alias("times"), F.array("rid").alias("rids"))
    paths = checkpointed(paths)
    one = lambda c: F.get(c, 0)
    nexts = paths.select(F.col("first").alias("last"), F.col("last").alias("to"), one("amts").alias("next_amt"), one("times").alias("next_t"), one("rids").alias("next_rid"), F.explode(F.array(bucket(one("times")) - 1, bucket(one("times")))).alias("at"))
    yield paths
    for _ in range(max_hops - 1):
        last_t = F.element_at("times", -1)
        on = step(F.element_at("amts", -1), last_t, F.col("next_amt"), F.col("next_t")) & (F.col("next_t") - last_t).between(0, within)
        open_ = paths.withColumn("at", bucket(last_t))
        grown = open_.join(nexts, ["last", "at"]).filter(on)
        if distinct:
            grown = grown.filter(~F.array_contains("nodes", F.col("to")))
        paths = grown.select("first", F.col("to").alias("last"), F.array_append("nodes", F.col("to")).alias("nodes"), F.array_append("amts", F.col("next_amt")).alias("amts"), F.array_append("times", F.col("next_t")).alias("times"), F.array_append("rids", F.col("next_rid")).alias("rids"))
        paths = checkpointed(paths)
        yield paths
