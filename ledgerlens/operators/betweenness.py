"""Betweenness from sampled pivots, and the graph's part of a risk score.

Shortest paths from all pivots are counted together, a table of (pivot, node).  Instead of a round for each level, nodes
first learn their ball: everything within some hops, with the number of shortest ways.  A round then settles as many
levels as the ball has, forwards for counts and backwards for dependencies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import register
from ..plans.fixpoint import checkpointed, once
from ..sources.ledger_view import legs
from .graph import _pairs, degrees, pagerank, with_centrality

PIVOTS = 200


def balls(links: DataFrame, growth: int = 8) -> tuple[DataFrame, int]:
    """(src, dst) without loops to ((node, to, dist, ways) of all pairs within `reach` hops, reach).

    The reach doubles while the table stays within `growth` times the links, so a graph in which everything is near
    keeps its links; the reach only decides the number of rounds, not what they find.
    """
    found = checkpointed(links.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.lit(1).alias("dist"), F.lit(1.0).alias("ways")))
    links_n = n = found.count()
    reach = 1
    while n:
        rim = found.filter(F.col("dist") == reach)
        meets = rim.groupBy(F.col("to").alias("node")).agg(F.count("*").alias("a")).join(found.groupBy("node").agg(F.count("*").alias("b")), "node").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
        if meets > 16 * growth * links_n:
            break
        after = found.select(F.col("node").alias("mid"), F.col("to").alias("end"), (F.col("dist") + reach).alias("far"), F.col("ways").alias("more"))
        grown = rim.select("node", F.col("to").alias("mid"), "ways").join(after, "mid").filter("node <> end")
        grown = grown.groupBy("node", F.col("end").alias("to"), "far").agg(F.sum(F.col("ways") * F.col("more")).alias("ways"))
        grown = grown.groupBy("node", "to").agg(F.min(F.struct("far", "ways")).alias("x")).select("node", "to", F.col("x.far").alias("dist"), F.col("x.ways").alias("ways"))
        grown = checkpointed(grown.join(found.select("node", "to"), ["node", "to"], "left_anti"))
        more = grown.count()
        if not more or n + more > growth * links_n:
            break
        found, n, reach = found.unionByName(grown), n + more, 2 * reach
    return found, reach


def betweenness(pairs: DataFrame, pivots: int = PIVOTS, growth: int = 8) -> DataFrame:
    """(id, betweenness) of all nodes of the directed graph (src, dst), each link counting one.

    Shortest paths start at the `pivots` nodes with the smallest hashes, or at all where there are no more; shares are
    scaled to all pairs of other nodes, and by nodes over pivots.  Ends when no pivot reaches anything new.
    """
    links = checkpointed(pairs.filter("src <> dst").select("src", "dst").distinct())
    nodes = checkpointed(pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    n = nodes.count()
    zero = nodes.select("id", F.lit(0.0).alias("betweenness"))
    if n <= 2:
        return zero
    ball, reach = balls(links, growth)
    starts = nodes.orderBy(F.xxhash64("id"), "id").limit(pivots)
    seeds = checkpointed(starts.select(F.col("id").alias("pivot"), F.col("id").alias("node"), F.lit(0).alias("level"), F.lit(1.0).alias("sigma")))
    seen, last = [seeds], 0
    while True:
        went = seen[-1].filter(F.col("level") == last).join(ball, "node").groupBy("pivot", F.col("to").alias("node"), (F.col("level") + F.col("dist")).alias("level")).agg(F.sum(F.col("sigma") * F.col("ways")).alias("sigma"))
        near = went.groupBy("pivot", "node").agg(F.min(F.struct("level", "sigma")).alias("x")).select("pivot", "node", "x.*")
        known = reduce(DataFrame.unionByName, seen).select("pivot", "node")
        seen.append(checkpointed(near.join(known, ["pivot", "node"], "left_anti")))
        last += reach
        if seen[-1].filter(F.col("level") == last).limit(1).count() == 0:
            break
    # paid: over all targets behind a node, shortest ways to it over the pivot's ways to it.
    paid, parts = None, []
    for k in range(len(seen) - 1, 0, -1):
        end, reached = k * reach, seen[k]
        if paid is None:
            reached = reached.withColumn("paid", F.lit(0.0))
        else:
            reached = reached.join(paid.select("pivot", "node", "paid"), ["pivot", "node"], "left")
        targets = reached.select("pivot", F.col("node").alias("to"), F.col("level").alias("at"), (1 / F.col("sigma") + F.coalesce("paid", F.lit(0.0))).alias("worth"))
        sources = seen[k - 1].filter(F.col("level") == end - reach).unionByName(seen[k].filter(F.col("level") < end))
        ways = sources.join(ball, "node").select("pivot", "node", "level", "sigma", "to", (F.col("level") + F.col("dist")).alias("at"), "ways")
        got = ways.join(targets, ["pivot", "to", "at"]).groupBy("pivot", "node", "level", "sigma").agg(F.sum(F.col("ways") * F.col("worth")).alias("paid"))
        got = checkpointed(got)
        parts.append(got.filter("node <> pivot").select(F.col("node").alias("id"), (F.col("sigma") * F.col("paid")).alias("share")))
        paid = got.filter(F.col("level") == end - reach)
    scale = n / min(pivots, n) / ((n - 1) * (n - 2))
    sums = reduce(DataFrame.unionByName, parts).groupBy("id").agg((F.sum("share") * scale).alias("betweenness"))
    return nodes.join(sums, "id", "left").fillna(0.0, ["betweenness"])


def graph_metrics(pairs: DataFrame, accounts: DataFrame, between: DataFrame | None = None) -> DataFrame:
    """(account_id, pagerank, betweenness, in_degree, out_degree, degree_centrality, graph_risk_score) of the accounts (account_id).

    The score is the sum of the three measures over its largest among the accounts; accounts without a link have zeros.
    `between` is betweenness() of the pairs where it is known already.
    """
    measured = with_centrality(degrees(pairs)).select("id", "in_degree", "out_degree", "degree_centrality")
    measured = measured.join(pagerank(pairs), "id").join(betweenness(pairs) if between is None else between, "id").withColumnRenamed("id", "account_id")
    rows = checkpointed(accounts.select("account_id").distinct().join(measured, "account_id", "left").fillna(0).withColumn("raw", F.col("pagerank") + F.col("betweenness") + F.col("degree_centrality")))
    top = rows.agg(F.max("raw").alias("top"))
    score = F.coalesce(F.try_divide("raw", "top"), F.lit(0.0))
    return rows.crossJoin(F.broadcast(top)).select("account_id", F.round("pagerank", 6).alias("pagerank"), F.round("betweenness", 6).alias("betweenness"), "in_degree", "out_degree", F.round("degree_centrality", 6).alias("degree_centrality"), F.round(score, 4).alias("graph_risk_score"))


def _between(s, d):
    return once(s, "betweenness", d, lambda: betweenness(_pairs(s, d)))


def _metrics(s, d):
    return once(s, "graph metrics", d, lambda: graph_metrics(_pairs(s, d), legs(s, d), _between(s, d)))


# Counting all shortest paths in SQL is too slow on the whole graph; tests hold both against brute force.
register("gr_betweenness", lambda s, d: _between(s, d).select(F.col("id").alias("account_id"), F.round("betweenness", 9).alias("betweenness")))
register("gr_graph_risk", _metrics)
