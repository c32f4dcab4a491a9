"""Risk that spreads over relationships, and views of the graph that grow where accounts are busy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import register
from ..plans.fixpoint import checkpointed
from ..sources.ledger_view import legs
from .graph import _EDGES, _edges, _seeds, account_graph, pagerank
from .relations import relationships
from .scores import _communities, _records

#: The score from which a relationship is an edge, and the shares of own and spread risk.
RELATED, OWN, SPREAD = 5.0, 0.6, 0.4


def propagated(relations: DataFrame, risks: DataFrame) -> DataFrame:
    """(account_id, original_risk, pagerank, propagated_risk, risk_elevation) of the accounts of risks (account_id, risk_score).

    Relationships of a score of RELATED and more are edges both ways, weighted by it.  Ranks start from each account's
    share of all risk, from all accounts alike where there is none; the highest rank counts as 100.  Without edges risks
    stay as they are.  An account without a score counts as 0; one that isn't in risks is no node.
    """
    risks = checkpointed(risks.filter("account_id is not null").select(F.col("account_id").alias("id"), F.coalesce("risk_score", F.lit(0.0)).alias("weight")))
    near = relations.filter(F.col("relationship_score") >= RELATED).select(F.col("account_a").alias("src"), F.col("account_b").alias("dst"), F.col("relationship_score").alias("total"))
    near = near.join(risks.select(F.col("id").alias("src")), "src", "left_semi").join(risks.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "total")
    near = checkpointed(near.unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "total")))
    original = risks.select(F.col("id").alias("account_id"), F.col("weight").alias("original_risk"))
    if near.isEmpty():
        return original.select("*", F.lit(0.0).alias("pagerank"), F.round("original_risk", 1).alias("propagated_risk"), F.lit(0.0).alias("risk_elevation"))
    ranks = pagerank(near, risks, others=risks).withColumnRenamed("id", "account_id")
    rows = original.join(ranks, "account_id").crossJoin(F.broadcast(ranks.agg(F.max("pagerank").alias("highest"))))
    spread = F.round(OWN * F.col("original_risk") + SPREAD * 100 * F.col("pagerank") / F.col("highest"), 1)
    return rows.select("account_id", "original_risk", F.round("pagerank", 9).alias("pagerank"), spread.alias("propagated_risk"), F.round(spread - F.col("original_risk"), 1).alias("risk_elevation"))


def _propagated(s, d):
    communities = _communities(s, d).select(F.col("id").alias("account_id"), F.col("community").alias("community_id"))
    return propagated(relationships(legs(s, d), communities), _records(s, d))


register("gr_pagerank_p", _propagated)


def grown_view(pairs: DataFrame, seeds: DataFrame, counts: DataFrame, threshold: int = 30, hops: int = 3) -> DataFrame:
    """(id, hop, expanded): the accounts near to seeds; only seeds and accounts with more than `threshold` rows show their neighbours.

    pairs are (src, dst), seeds (id), counts (id, n).  A seed without an edge isn't shown.  Accounts at the last hop aren't
    expanded.  Each hop is one join of the frontier with the links, written, and sees each account once.
    """
    links = checkpointed(pairs.select("src", "dst").union(pairs.select("dst", "src")).distinct())
    busy = counts.filter(F.col("n") > threshold).select("id", F.lit(True).alias("busy"))
    first = seeds.select("id").distinct().join(links.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    seen = checkpointed(first.select("id", F.lit(0).alias("hop"), F.lit(True).alias("expanded")))
    for hop in range(1, hops + 1):
        frontier = seen.filter((F.col("hop") == hop - 1) & F.col("expanded")).select(F.col("id").alias("src"))
        new = links.join(frontier, "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        new = new.join(busy, "id", "left").select("id", F.lit(hop).alias("hop"), (F.coalesce("busy", F.lit(False)) & F.lit(hop < hops)).alias("expanded"))
        seen = checkpointed(seen.unionByName(new))
    return seen


#: Half of the query's accounts have more rows than this, so that there are leaves.
_BUSY = 80
register(
    "gr_incremental",
    lambda s, d: (lambda p: grown_view(p, _seeds(p), legs(s, d).groupBy(F.col("account_id").alias("id")).agg(F.count("*").alias("n")), _BUSY))(account_graph(_edges(s, d)).drop("leg_ids")).select(F.col("id").alias("account_id"), "hop", "expanded"),
    f"""{_EDGES}, counts AS MATERIALIZED (SELECT account_id AS id, count(*) AS n FROM legs GROUP BY 1),
seeds AS MATERIALIZED (SELECT DISTINCT src AS id FROM pairs WHERE substr(src, 5, 4) IN ('0001', '0500')),
links AS MATERIALIZED (SELECT src AS id, dst AS nxt FROM pairs UNION SELECT dst, src FROM pairs),
busy AS MATERIALIZED (SELECT id FROM counts WHERE n > {_BUSY} UNION SELECT id FROM seeds),
walk AS (SELECT id, 0 AS hop FROM seeds UNION SELECT l.nxt, hop + 1 FROM walk w JOIN busy USING (id) JOIN links l ON l.id = w.id WHERE hop < 3)
SELECT id AS account_id, min(hop) AS hop, min(hop) < 3 AND id IN (SELECT id FROM busy) AS expanded FROM walk GROUP BY 1""",
)
