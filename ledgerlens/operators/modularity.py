"""Communities by modularity: nodes move to the neighbouring community that gains most, communities become nodes, until nothing gains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import register
from ..plans.fixpoint import checkpointed, once
from .graph import _pairs, community_summary

#: Gains below this end a level and the search; rounds of one level beyond which it counts as not converging.
GAIN, ROUNDS = 1e-6, 200


def symmetric(pairs: DataFrame) -> DataFrame:
    """(src, dst, total) to (src, dst, w), every link in both directions; a loop counts twice, as in a degree."""
    ends = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    return pairs.filter("src is not null and dst is not null and total > 0").select(F.explode(ends).alias("e"), "total").groupBy(F.col("e.a").alias("src"), F.col("e.b").alias("dst")).agg(F.sum(F.col("total").cast("double")).alias("w"))


def modularity(both: DataFrame, labels: DataFrame) -> float:
    """Of labels (id, community): the share of weight inside communities less what their degrees let expect; 0 without weight."""
    of = lambda end: labels.select(F.col("id").alias(end), F.col("community").alias(f"{end}_c"))
    rows = both.join(of("src"), "src").join(of("dst"), "dst")
    sums = rows.groupBy("src_c").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("src_c") == F.col("dst_c"), F.col("w")).otherwise(0.0)).alias("inside"))
    total, inside, squares = sums.agg(F.sum("all"), F.sum("inside"), F.sum(F.col("all") * F.col("all"))).first()
    return 0.0 if not total else inside / total - squares / (total * total)


def _moved(both: DataFrame, degrees: DataFrame, labels: DataFrame, total: float, turn: int) -> DataFrame:
    """Labels after each node of this turn (a hash's half) went where modularity gains most; (id, community, moved)."""
    sizes = labels.join(degrees, "id").groupBy("community").agg(F.sum("k").alias("all"), F.count("*").alias("n"))
    other = labels.select(F.col("id").alias("dst"), F.col("community"))
    votes = both.filter("src <> dst").join(other, "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("w").alias("w"))
    stay = labels.select("id", "community", F.lit(0.0).alias("w"))
    votes = votes.unionByName(stay).groupBy("id", "community").agg(F.sum("w").alias("w"))
    own = labels.withColumnRenamed("community", "own").join(sizes.select(F.col("community").alias("own"), F.col("n").alias("own_n")), "own")
    rated = votes.join(own, "id").join(degrees, "id").join(sizes, "community")
    here = F.col("community") == F.col("own")
    gain = F.col("w") - F.col("k") * (F.col("all") - F.when(here, F.col("k")).otherwise(0.0)) / total
    # Two single nodes go to the smaller one of them, else they would swap.
    allowed = here | ~((F.col("n") == 1) & (F.col("own_n") == 1) & (F.col("community") > F.col("own")))
    best = rated.filter(allowed).withColumn("gain", gain).groupBy("id", "own").agg(F.min_by(F.struct("community", "gain"), F.struct(-F.col("gain"), ~here, "community")).alias("best"), F.max(F.when(here, F.col("gain"))).alias("now"))
    goes = (F.pmod(F.xxhash64("id"), F.lit(2)) == turn % 2) & (F.col("best.gain") > F.col("now") + 1e-12 * total)
    return best.select("id", F.when(goes, F.col("best.community")).otherwise(F.col("own")).alias("community"), goes.alias("moved"))


def _level(both: DataFrame, total: float) -> tuple[DataFrame, float]:
    """The best labels that local moves find from single nodes on, and their modularity.

    Halves of the nodes, by a hash, take turns.  Ends when both turns after each other move nothing or don't gain;
    the labels with the largest modularity stay, so moves that hinder each other are never kept.
    """
    degrees = checkpointed(both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
    labels = best = checkpointed(degrees.select("id", F.col("id").alias("community")))
    most, idle = modularity(both, labels), 0
    for turn in range(ROUNDS):
        moved = checkpointed(_moved(both, degrees, labels, total, turn))
        labels = moved.drop("moved")
        now = modularity(both, labels)
        idle = 0 if now > most + GAIN else idle + 1
        if now > most:
            best, most = labels, now
        if idle == 2:
            return best, most
    raise ArithmeticError(f"communities still move after {ROUNDS} rounds")


def modular_communities(pairs: DataFrame) -> DataFrame:
    """(src, dst, total) to (id, community): community is the smallest id of its members.

    Levels of local moves and contraction go on while modularity grows; each level's communities are the next one's
    nodes.  Nodes without a positive link, and links with a null end, give nothing.
    """
    both = checkpointed(symmetric(pairs))
    total = both.agg(F.sum("w")).first()[0] or 0.0
    names = checkpointed(both.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id")))
    most, links = modularity(both, names), both
    while total:
        labels, now = _level(links, total)
        if now <= most + GAIN:
            break
        most = now
        names = checkpointed(names.join(labels.select(F.col("id").alias("community"), F.col("community").alias("next")), "community").select("id", F.col("next").alias("community")))
        of = lambda end: labels.select(F.col("id").alias(end), F.col("community").alias(f"{end}_c"))  # noqa: E731, B023
        links = checkpointed(links.join(of("src"), "src").join(of("dst"), "dst").groupBy(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).agg(F.sum("w").alias("w")))
    least = names.groupBy("community").agg(F.min("id").alias("least"))
    return names.join(least, "community").select("id", F.col("least").alias("community"))


# Moves depend on all moves before, which SQL can't follow; tests hold planted parts and the gain over label rounds.
def _communities(s, d):
    return once(s, "communities", d, lambda: modular_communities(_pairs(s, d)))


register("gr_community", lambda s, d: _communities(s, d).withColumnRenamed("id", "account_id"))
register("ag_community_summary", lambda s, d: community_summary(_pairs(s, d), _communities(s, d)))
