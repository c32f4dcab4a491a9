"""The transfer graph: builds, measures, neighbourhoods, components, centrality and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..plans.fixpoint import checkpointed, fixpoint
from ..schema import joined
from ..sources.ledger_view import LEGS_SQL, legs

#: In the queries the party of every eleventh transfer is known by a name from outside, which has no account here.
_PARTY = "CASE WHEN rid % 11 = 0 THEN concat('X', substr(cp, 2)) ELSE cp END"


def transaction_edges(ledger: DataFrame) -> DataFrame:
    """Every debit with a party is an edge; credits are edges only if their sender has no account of its own."""
    accounts = ledger.select(F.col("account_id").alias("cp")).distinct()
    debits = ledger.filter("debit > 0 and cp <> ''").select(F.col("account_id").alias("src"), F.col("cp").alias("dst"), F.col("debit").alias("amount"), "leg_id", "ts", "channel")
    outside = ledger.filter("credit > 0 and cp <> ''").join(accounts, "cp", "left_anti").select(F.col("cp").alias("src"), F.col("account_id").alias("dst"), F.col("credit").alias("amount"), "leg_id", "ts", "channel")
    return debits.unionByName(outside)


def with_outside(ledger: DataFrame) -> DataFrame:
    """The whole ledger, with some parties from outside."""
    return ledger.withColumn("cp", F.expr(_PARTY))


_EDGES = f"""WITH RECURSIVE {LEGS_SQL},
known AS (SELECT * REPLACE ({_PARTY} AS cp) FROM legs),
edges AS (SELECT account_id AS src, cp AS dst, debit AS amount, leg_id, ts, channel FROM known WHERE debit > 0
  UNION ALL SELECT cp, account_id, credit, leg_id, ts, channel FROM known WHERE credit > 0 AND cp NOT IN (SELECT account_id FROM known)),
pairs AS (SELECT src, dst, sum(amount) AS total, count(*) AS n FROM edges GROUP BY 1, 2)"""


def account_graph(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.sum("amount").alias("total"), F.count("*").alias("n"), F.sort_array(F.collect_list("leg_id")).alias("leg_ids"))


def _edges(s, d):
    return transaction_edges(with_outside(legs(s, d)))


register("gr_build", lambda s, d: _edges(s, d).select("src", "dst", F.col("amount").cast("double").alias("amount"), "leg_id"), f"{_EDGES} SELECT src, dst, CAST(amount AS DOUBLE) AS amount, leg_id FROM edges")
register("ag_account_graph", lambda s, d: account_graph(_edges(s, d)).select("src", "dst", F.col("total").cast("double").alias("total_amount"), F.col("n").alias("txn_count")), f"{_EDGES} SELECT src, dst, CAST(total AS DOUBLE) AS total_amount, n AS txn_count FROM pairs")
register(
    "jn_semi_internal",
    lambda s, d: with_outside(legs(s, d)).filter("debit > 0").join(with_outside(legs(s, d)).select(F.col("account_id").alias("cp")).distinct(), "cp", "left_semi").groupBy("account_id").agg(F.count("*").alias("internal_debits")),
    f"{_EDGES} SELECT account_id, count(*) AS internal_debits FROM known WHERE debit > 0 AND cp IN (SELECT account_id FROM known) GROUP BY 1",
)


def degrees(pairs: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, inflow, outflow) of every node."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("out"), F.col("total")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("out"), F.col("total")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.count_if(F.col("out") == 0).alias("in_degree"), F.count_if(F.col("out") == 1).alias("out_degree"), F.sum(F.when(F.col("out") == 0, F.col("total")).otherwise(0)).alias("inflow"), F.sum(F.when(F.col("out") == 1, F.col("total")).otherwise(0)).alias("outflow"))


_DEG = f"""{_EDGES},
ends AS (SELECT src AS id, 1 AS o, total FROM pairs UNION ALL SELECT dst, 0, total FROM pairs),
deg AS (SELECT id, count(*) FILTER (o = 0) AS in_degree, count(*) FILTER (o = 1) AS out_degree, coalesce(sum(total) FILTER (o = 0), 0) AS inflow, coalesce(sum(total) FILTER (o = 1), 0) AS outflow FROM ends GROUP BY 1)"""


def _deg(s, d):
    return degrees(account_graph(_edges(s, d)))


def with_centrality(deg: DataFrame) -> DataFrame:
    n = deg.agg(F.count("*").alias("nodes"))
    return deg.crossJoin(F.broadcast(n)).withColumn("degree_centrality", (F.col("in_degree") + F.col("out_degree")) / (F.col("nodes") - 1)).drop("nodes")


register("gr_degree", lambda s, d: with_centrality(_deg(s, d)).select(F.col("id").alias("account_id"), "in_degree", "out_degree", F.round("degree_centrality", 6).alias("degree_centrality")), f"{_DEG} SELECT id AS account_id, in_degree, out_degree, round((in_degree + out_degree) / ((SELECT count(*) FROM deg) - 1), 6) AS degree_centrality FROM deg")
register(
    "ag_accumulation",
    lambda s, d: _deg(s, d).select(F.col("id").alias("account_id"), F.col("inflow").cast("double").alias("inflow"), F.col("outflow").cast("double").alias("outflow"), (F.col("inflow") - F.col("outflow")).alias("net")).orderBy(F.desc("net"), "account_id").limit(50).withColumn("net", F.col("net").cast("double")),
    f"{_DEG} SELECT id AS account_id, CAST(inflow AS DOUBLE) AS inflow, CAST(outflow AS DOUBLE) AS outflow, CAST(inflow - outflow AS DOUBLE) AS net FROM deg ORDER BY inflow - outflow DESC, id LIMIT 50",
)


def role():
    return F.when((F.col("in_degree") == 0) & (F.col("out_degree") == 0), "isolated").when(F.col("in_degree") == 0, "source").when((F.col("out_degree") == 0) | (F.col("inflow") > F.col("outflow") * F.lit(1.3).cast("decimal(2,1)")), "destination").otherwise("intermediary")


register("gr_roles", lambda s, d: _deg(s, d).select(F.col("id").alias("account_id"), role().alias("role")), f"{_DEG} SELECT id AS account_id, CASE WHEN in_degree = 0 AND out_degree = 0 THEN 'isolated' WHEN in_degree = 0 THEN 'source' WHEN out_degree = 0 OR inflow > outflow * 1.3 THEN 'destination' ELSE 'intermediary' END AS role FROM deg")


def reach(pairs: DataFrame, seeds: DataFrame, hops: int, direction: str = "both") -> DataFrame:
    """(id, hop): nodes within some hops of the seeds (id), each with its smallest hop; only new nodes go on."""
    out = pairs.select(F.col("src").alias("id"), F.col("dst").alias("to"))
    back = pairs.select(F.col("dst").alias("id"), F.col("src").alias("to"))
    links = checkpointed((out if direction == "out" else back if direction == "in" else out.unionByName(back)).distinct())
    seen = checkpointed(seeds.select("id", F.lit(0).alias("hop")).distinct())
    frontier = seen.select("id")
    for hop in range(1, hops + 1):
        frontier = links.join(frontier, "id", "left_semi").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = checkpointed(frontier)
        seen = seen.unionByName(frontier.withColumn("hop", F.lit(hop)))
    return seen


def _seeds(pairs: DataFrame) -> DataFrame:
    return pairs.filter("substr(src, 5, 4) in ('0001', '0500')").select(F.col("src").alias("id")).distinct()


_REACH = """{base},
links AS (SELECT src AS id, dst AS nxt FROM pairs {back}),
walk AS (SELECT DISTINCT src AS id, 0 AS hop FROM pairs WHERE substr(src, 5, 4) IN ('0001', '0500') UNION SELECT l.nxt, hop + 1 FROM walk w JOIN links l ON l.id = w.id WHERE hop < {hops})
SELECT id AS account_id, min(hop) AS hop FROM walk GROUP BY 1"""
for _name, _hops, _dir in (("gr_bfs_hops", 3, "both"), ("gr_ego2", 2, "both"), ("gr_subgraph_dir", 3, "out")):
    register(
        _name,
        lambda s, d, h=_hops, w=_dir: (lambda p: reach(p, _seeds(p), h, w).select(F.col("id").alias("account_id"), "hop"))(account_graph(_edges(s, d)).drop("leg_ids")),
        _REACH.format(base=_EDGES, hops=_hops, back="UNION SELECT dst, src FROM pairs" if _dir == "both" else ""),
    )
register(
    "gr_expand",
    lambda s, d: (lambda p: (lambda r: p.join(r.select(F.col("id").alias("src")), "src", "left_semi").join(r.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", F.col("n").alias("txn_count")))(reach(p, _seeds(p), 1)))(account_graph(_edges(s, d)).drop("leg_ids")),
    _REACH.format(base=_EDGES, hops=1, back="UNION SELECT dst, src FROM pairs").replace("SELECT id AS account_id, min(hop) AS hop FROM walk GROUP BY 1", "SELECT src, dst, n AS txn_count FROM pairs WHERE src IN (SELECT id FROM walk) AND dst IN (SELECT id FROM walk)"),
)


def components(pairs: DataFrame) -> DataFrame:
    """(id, component): the smallest node of each weakly connected part.  Labels spread along edges, then jump to their own labels."""
    both = pairs.select("src", "dst").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = checkpointed(both)
    start = both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("src")).alias("component")).withColumn("changed", F.lit(True))

    def step(state: DataFrame) -> DataFrame:
        near = both.join(state.select(F.col("id").alias("dst"), F.col("component").alias("other")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("other").alias("near"))
        spread = state.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("via"))
        up = state.select(F.col("id").alias("via"), F.col("component").alias("up"))
        new = F.least("via", F.coalesce("up", "via"))
        return spread.join(up, "via", "left").select("id", new.alias("component"), (new != F.col("was")).alias("changed"))

    return fixpoint(start, step, "changed").select("id", "component")


def _pairs(s, d):
    """Every pair of accounts with an edge, written once for the readers of a query."""
    return checkpointed(account_graph(_edges(s, d)).drop("leg_ids"))


def graph_summary(pairs: DataFrame, accounts: DataFrame) -> DataFrame:
    """Nodes, those with an account (account_id) and those without, components, edges, transactions and density."""
    own = accounts.select(F.col("account_id").alias("id"), F.lit(True).alias("own")).distinct()
    nodes = components(pairs).join(own, "id", "left").agg(F.count("*").alias("nodes"), F.count("own").alias("internal"), F.count_if(F.col("own").isNull()).alias("external"), F.count_distinct("component").alias("components"))
    return nodes.crossJoin(pairs.agg(F.count("*").alias("edges"), F.sum("n").alias("transactions"))).withColumn("density", F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 8))


# SQL that closes the whole graph is too slow; tests hold these two against brute force over all edges.
register("gr_wcc", lambda s, d: components(_pairs(s, d)).withColumnRenamed("id", "account_id"))
register("ag_graph_summary", lambda s, d: graph_summary(_pairs(s, d), legs(s, d)))


def pagerank(pairs: DataFrame, personal: DataFrame | None = None, damping: float = 0.85, rounds: int = 100, others: DataFrame | None = None) -> DataFrame:
    """(id, pagerank): weighted by amounts; what dead ends hold is given out by the start weights.

    `personal` is (id, weight); without it, or where all weights are 0, all nodes start alike.  `others` is (id) of nodes
    that may have no edge.  Every round is one join on the source and one sum,
    combined before the shuffle; ranks stop when they move by less than 1e-9 in sum, or after
    `rounds`, when that sum is below 2 * damping ** rounds, else it is an error.
    """
    links = pairs.join(pairs.groupBy("src").agg(F.sum("total").alias("of")), "src").select("src", "dst", (F.col("total") / F.col("of")).cast("double").alias("share"))
    links = checkpointed(links)
    nodes = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    nodes = nodes if others is None else nodes.union(others.select("id")).distinct()
    weights = nodes.withColumn("w", F.lit(1.0)) if personal is None else nodes.join(personal.select("id", F.col("weight").cast("double").alias("w")), "id", "left").fillna(0.0, ["w"])
    sums = weights.agg(F.sum("w").alias("all_w"), F.count("*").alias("nodes"))
    share = F.when(F.col("all_w") > 0, F.try_divide("w", "all_w")).otherwise(1 / F.col("nodes"))
    start = checkpointed(weights.crossJoin(F.broadcast(sums)).select("id", share.alias("p")).join(links.select(F.col("src").alias("id"), F.lit(True).alias("gives")).distinct(), "id", "left"))
    ranks = start.select("id", F.col("p").alias("rank"))
    for _ in range(rounds):
        inflow = links.join(ranks.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        lost = ranks.join(start.filter("gives is null").select("id"), "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        new = start.join(inflow, "id", "left").join(ranks, "id").crossJoin(F.broadcast(lost))
        new = checkpointed(new.select("id", F.col("rank").alias("was"), ((1 - damping) * F.col("p") + damping * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") * F.col("p"))).alias("rank")))
        ranks = new.select("id", "rank")
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0
        if moved < 1e-9:
            break
    else:
        if moved > 2 * damping**rounds:
            raise ArithmeticError(f"ranks still move by {moved} after {rounds} rounds")
    return ranks.withColumnRenamed("rank", "pagerank")


register("gr_pagerank_w", lambda s, d: pagerank(account_graph(_edges(s, d)).drop("leg_ids")).select(F.col("id").alias("account_id"), F.round("pagerank", 6).alias("pagerank")))


def communities(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, community): weighted label propagation until no label changes; ties go to the node's own label, then to the smaller.

    Odd and even nodes, by a hash, take turns, so that two sides can't swap labels for ever.  Labels that still change
    after `rounds` turns are an error.
    """
    both = pairs.select("src", "dst", "total").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "total"))
    both = checkpointed(both.filter("src <> dst").groupBy("src", "dst").agg(F.sum("total").alias("w")))
    labels, idle = checkpointed(both.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))), 0
    for k in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("w").alias("w"))
        own = labels.withColumnRenamed("community", "own")
        best = votes.join(own, "id").groupBy("id", "own").agg(F.min_by("community", F.struct(-F.col("w"), F.col("community") != F.col("own"), "community")).alias("best"))
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == k % 2
        new = checkpointed(best.select("id", F.when(turn, F.col("best")).otherwise(F.col("own")).alias("community"), (turn & (F.col("best") != F.col("own"))).alias("changed")))
        labels = new.drop("changed")
        idle = 0 if new.filter("changed").limit(1).count() else idle + 1
        if idle == 2:
            return labels
    raise ArithmeticError(f"labels still change after {rounds} rounds")


def community_summary(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    a, b = labels.select(F.col("id").alias("src"), F.col("community").alias("community")), labels.select(F.col("id").alias("dst"), F.col("community").alias("other"))
    flows = pairs.join(a, "src").join(b, "dst").groupBy("community").agg(F.sum("total").alias("flow"), F.sum(F.when(F.col("community") == F.col("other"), F.col("total")).otherwise(0)).alias("inside"))
    out = pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    top = labels.join(out, "id", "left").fillna(0, ["degree"]).withColumn("k", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "id")))
    sizes = top.groupBy("community").agg(F.count("*").alias("size"), F.sort_array(F.collect_list(F.when(F.col("k") <= 5, F.col("id")))).alias("top"))
    return sizes.join(flows, "community", "left").select("community", "size", F.coalesce("flow", F.lit(0)).cast("double").alias("total_flow"), F.coalesce(F.round(F.col("inside") / F.nullif("flow", F.lit(0)), 3).cast("double"), F.lit(0.0)).alias("internal_ratio"), joined(F.col("top")).alias("top_accounts"))


register(
    "gr_edge_detail",
    lambda s, d: _edges(s, d).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "amount", "channel", "leg_id").groupBy("a", "b", "channel").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total")),
    f"{_EDGES} SELECT least(src, dst) AS a, greatest(src, dst) AS b, channel, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM edges GROUP BY 1, 2, 3",
)
register(
    "snk_graph_json",
    lambda s, d: account_graph(_edges(s, d)).select(F.to_json(F.struct(F.struct(F.concat_ws("_", "src", "dst").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), F.col("n").alias("count")).alias("data"))).alias("element")),
    f"""{_EDGES} SELECT '{{"data":{{"id":"' || src || '_' || dst || '","source":"' || src || '","target":"' || dst || '","count":' || n || '}}}}' AS element FROM pairs""",
)
