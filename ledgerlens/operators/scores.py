"""The risk record of every account: intensities of eleven patterns, the score and tier, what is active and why."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import ORACLES, register
from ..plans.fixpoint import checkpointed, once
from ..schema import ODD, WEIGHTS, epoch
from ..sources.ledger_view import LEGS_SQL, balanced_legs
from .betweenness import _metrics
from .modularity import _communities
from .paths import layering, round_trips
from .risk import beneficiaries, community_risk, count_score, risk_tier
from .windows import balance_breaks, fan, iqr_outliers, odd_hours, smurfing, velocity

COUNTED, RATED = ["round_trip", "layering", "fan_in", "fan_out", "smurfing", "odd_hour"], ["velocity", "high_value", "balance_breach"]
PATTERNS = [*COUNTED, *RATED, "new_hv_bene"]
#: From this graph score on an account counts as central.
CENTRAL = 0.65
#: What each pattern says in a record.
REASONS = {
    "layering": "Participates in temporal internal transfer chain",
    "smurfing": "Structured similarly sized transfers relative to own activity",
    "velocity": "Velocity bursts",
    "high_value": "Per-account high-value outliers",
    "balance_breach": "Statement balance continuity issues",
    "new_hv_bene": "New high-value beneficiary",
    "graph": "Graph-central account by PageRank/betweenness/degree",
    "none": "No material analytics patterns detected",
}


def pattern_counts(ledger: DataFrame) -> DataFrame:
    """(account_id, n, a count for each of PATTERNS, sender_count, receiver_count) from a ledger with balances; chains count for each account on them."""
    edges = ledger.filter("debit > 0").select(F.col("account_id").alias("src"), F.col("cp").alias("dst"), F.col("debit").alias("amt"), epoch(F.col("ts")).alias("t"), F.col("leg_id").alias("rid"))
    tell = lambda rows, name, account="account_id": rows.select(F.col(account).alias("account_id"), F.lit(name).alias("pattern"), F.lit(1).cast("long").alias("hits"), F.lit(None).cast("long").alias("parties"))
    both = lambda rows, name: rows.select("account_id", F.lit(name).alias("pattern"), F.lit(1).cast("long").alias("hits"), F.col("n_parties").alias("parties"))
    found = [
        tell(round_trips(ledger).select(F.explode(F.array("account_a", "account_b")).alias("account_id")), "round_trip"),
        tell(layering(edges).select(F.explode("nodes").alias("account_id")), "layering"),
        both(fan(ledger, "in"), "fan_in"),
        both(fan(ledger, "out"), "fan_out"),
        tell(smurfing(ledger), "smurfing", "account"),
        tell(odd_hours(ledger), "odd_hour", "account"),
        tell(velocity(ledger).filter("is_velocity_flag"), "velocity"),
        tell(iqr_outliers(ledger).select("account_id", "leg_id").distinct(), "high_value"),
        tell(balance_breaks(ledger).filter("kind <> 'OK'"), "balance_breach"),
        tell(beneficiaries(ledger).filter("is_new_high_value_bene"), "new_hv_bene"),
    ]
    # Each pattern is counted by account and written, so its rows and shuffles are gone before the next one's.
    summed = lambda rows: rows.groupBy("account_id", "pattern").agg(F.sum("hits").alias("hits"), F.max("parties").alias("parties"))
    counts = reduce(DataFrame.unionByName, [checkpointed(summed(rows)) for rows in (tell(ledger, "n"), *found)])
    of = lambda p: F.coalesce(F.max(F.when(F.col("pattern") == p, F.col("hits"))), F.lit(0)).alias(p)
    most = lambda p, name: F.max(F.when(F.col("pattern") == p, F.col("parties"))).alias(name)
    return counts.groupBy("account_id").agg(*map(of, ["n", *PATTERNS]), most("fan_in", "sender_count"), most("fan_out", "receiver_count")).filter("n > 0")


def intensities(counts: DataFrame) -> DataFrame:
    """Adds level_<pattern>, from 0 to 1: counts by their logarithm, rates of rows by their root, a new beneficiary as it is."""
    level = {p: count_score(F.col(p)) for p in COUNTED} | {p: F.least(F.sqrt(F.col(p) / F.col("n")), F.lit(1.0)) for p in RATED}
    level["new_hv_bene"] = F.when(F.col("new_hv_bene") > 0, 1.0).otherwise(0.0)
    return counts.withColumns({f"level_{p}": v for p, v in level.items()})


def risk(ledger: DataFrame, metrics: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """The risk record of each account of a ledger with balances, holder and bank left out.

    metrics are graph_metrics(), whose score is the eleventh pattern, else 0; labels (id, community) give community_id,
    else null.  Where no account is HIGH, lower tiers' bounds count.  Reasons name the most parties of a fan.
    """
    rows = intensities(pattern_counts(ledger))
    if metrics is not None:
        rows = rows.join(metrics, "account_id", "left")
    else:
        rows = rows.withColumns({"graph_risk_score": F.lit(0.0), **{c: F.lit(0.0) for c in ("pagerank", "betweenness", "degree_centrality")}, **{c: F.lit(0).cast("long") for c in ("in_degree", "out_degree")}})
    rows = rows.join(labels.select(F.col("id").alias("account_id"), F.col("community").alias("community_id")), "account_id", "left") if labels is not None else rows.withColumn("community_id", F.lit(None).cast("string"))
    rows = rows.fillna(0).withColumn("level_graph", F.col("graph_risk_score"))
    raw = sum((WEIGHTS[p] * F.col(f"level_{p}") for p in [*PATTERNS, "graph"]), F.lit(0.0)) * 100
    flag = {p: F.col(f"level_{p}") > 0 for p in PATTERNS}
    central = F.col("level_graph") >= CENTRAL
    active = F.array_compact(F.array(*(F.when(flag[p], p.upper()) for p in PATTERNS), F.when(central, "GRAPH_CENTRAL")))
    told = {p: F.lit(t) for p, t in REASONS.items()} | {
        "round_trip": F.format_string("Round-trip indicators present (%.2f intensity)", F.col("level_round_trip")),
        "fan_in": F.format_string("Collector behaviour: %d senders", F.col("sender_count")),
        "fan_out": F.format_string("Distributor behaviour: %d receivers", F.col("receiver_count")),
        "odd_hour": F.lit(f"Real timestamped odd-hour activity between {ODD['start']:02d}:00-{ODD['end']:02d}:00"),
    }
    reasons = F.array_compact(F.array(*(F.when(flag[p], told[p]) for p in PATTERNS), F.when(central, told["graph"])))
    scored = rows.withColumns({"risk_score": F.least(F.round(raw, 1), F.lit(100.0)), "active": active, "reasons": reasons})
    scored = checkpointed(scored)
    seen = scored.agg((F.max("risk_score") >= 50).alias("high_seen"))
    return scored.crossJoin(F.broadcast(seen)).select(
        "account_id", "community_id", "risk_score", risk_tier(F.col("risk_score"), F.col("high_seen")).alias("risk_tier"), *(flag[p].alias(f"flag_{p}") for p in PATTERNS),
        "pagerank", "betweenness", "in_degree", "out_degree", "degree_centrality", "graph_risk_score",
        F.when(F.size("active") == 0, "NONE").otherwise(F.array_join("active", " | ")).alias("active_patterns"),
        F.when(F.size("reasons") == 0, told["none"]).otherwise(F.array_join("reasons", " | ")).alias("risk_reasoning"),
    )


def _ledger(s, d):
    """The ledger with balances, written once for all detectors of a query."""
    return balanced_legs(s, d)


def _records(s, d):
    return once(s, "risk records", d, lambda: risk(_ledger(s, d), _metrics(s, d), _communities(s, d)))


_SHOWN = ["account_id", "risk_score", "risk_tier", *(f"flag_{p}" for p in PATTERNS), "active_patterns", "risk_reasoning"]
_count = lambda source, account, where="true": f"SELECT {account} AS account_id, count(*) AS k FROM ({ORACLES[source]}) z WHERE {where} GROUP BY 1"
_level = lambda p: f"least(ln(1 + coalesce({p}.k, 0)) / ln(6.0::DOUBLE), 1.0)" if p in COUNTED else f"least(sqrt(coalesce({p}.k, 0) / n), 1.0)" if p in RATED else f"CASE WHEN {p}.k > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_TERMS = {
    "round_trip": f"SELECT account_id, count(*) AS k FROM (SELECT unnest([account_a, account_b]) AS account_id FROM ({ORACLES['jn_ts_range']}) z) y GROUP BY 1",
    "layering": f"SELECT account_id, count(*) AS k FROM (SELECT unnest(string_split(chain, '>')) AS account_id FROM ({ORACLES['gr_layering']}) z) y GROUP BY 1",
    "fan_in": f"SELECT collector AS account_id, count(*) AS k, max(sender_count) AS parties FROM ({ORACLES['wn_fan_in']}) z GROUP BY 1",
    "fan_out": f"SELECT distributor AS account_id, count(*) AS k, max(receiver_count) AS parties FROM ({ORACLES['wn_fan_out']}) z GROUP BY 1",
    "smurfing": _count("wn_smurf", "account"),
    "odd_hour": _count("ag_odd_hours", "account"),
    "velocity": _count("wn_velocity", "account_id"),
    "high_value": f"""WITH {LEGS_SQL}, sides AS (SELECT leg_id, account_id, 'debit' AS side, CAST(debit AS DOUBLE) AS amount FROM legs UNION ALL SELECT leg_id, account_id, 'credit', CAST(credit AS DOUBLE) FROM legs),
q AS (SELECT account_id, side, quantile_cont(amount, 0.25) FILTER (amount > 0) AS q1, quantile_cont(amount, 0.75) FILTER (amount > 0) AS q3 FROM sides GROUP BY 1, 2 HAVING count(*) >= 10 AND count(*) FILTER (amount > 0) >= 4)
SELECT account_id, count(DISTINCT leg_id) AS k FROM sides JOIN q USING (account_id, side) WHERE q3 <> q1 AND amount > q3 + 3.0 * (q3 - q1) GROUP BY 1""",
    "balance_breach": _count("wn_balance", "account_id"),
    "new_hv_bene": _count("ag_beneficiary", "account_id", "is_new_high_value_bene"),
}
_told = {**{p: f"'{t}'" for p, t in REASONS.items()}, "round_trip": "printf('Round-trip indicators present (%.2f intensity)', l_round_trip)", "fan_in": "'Collector behaviour: ' || senders || ' senders'", "fan_out": "'Distributor behaviour: ' || receivers || ' receivers'", "odd_hour": f"'Real timestamped odd-hour activity between {ODD['start']:02d}:00-{ODD['end']:02d}:00'"}
_RISK = f"""WITH accounts AS (WITH {LEGS_SQL} SELECT account_id, count(*) AS n FROM legs GROUP BY 1),
{", ".join(f"{p} AS MATERIALIZED ({q})" for p, q in _TERMS.items())},
levels AS (SELECT accounts.account_id, {", ".join(f"{_level(p)} AS l_{p}" for p in PATTERNS)}, fan_in.parties AS senders, fan_out.parties AS receivers FROM accounts {" ".join(f"LEFT JOIN {p} ON {p}.account_id = accounts.account_id" for p in PATTERNS)}),
scored AS (SELECT *, least(round(({" + ".join(f"{WEIGHTS[p]}::DOUBLE * l_{p}" for p in PATTERNS)}) * 100, 1), 100.0) AS risk_score FROM levels),
seen AS (SELECT max(risk_score) >= 50 AS high FROM scored)
SELECT account_id, risk_score, CASE WHEN high THEN CASE WHEN risk_score >= 75 THEN 'CRITICAL' WHEN risk_score >= 50 THEN 'HIGH' WHEN risk_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END ELSE CASE WHEN risk_score >= 45 THEN 'CRITICAL' WHEN risk_score >= 30 THEN 'HIGH' WHEN risk_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END END AS risk_tier,
  {", ".join(f"l_{p} > 0 AS flag_{p}" for p in PATTERNS)},
  coalesce(nullif(concat_ws(' | ', {", ".join(f"CASE WHEN l_{p} > 0 THEN '{p.upper()}' END" for p in PATTERNS)}), ''), 'NONE') AS active_patterns,
  coalesce(nullif(concat_ws(' | ', {", ".join(f"CASE WHEN l_{p} > 0 THEN {_told[p]} END" for p in PATTERNS)}), ''), '{REASONS["none"]}') AS risk_reasoning FROM scored CROSS JOIN seen"""
# Without the graph's part SQL gives the record; the whole one needs ranks, shortest paths and communities.
register("ag_risk", lambda s, d: risk(_ledger(s, d)).select(_SHOWN), _RISK)
register("ag_risk_graph", _records)
register("ag_reasoning", lambda s, d: risk(_ledger(s, d)).select("account_id", F.explode(F.split("risk_reasoning", r" \| ")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n_accounts")), f"SELECT reason, count(*) AS n_accounts FROM (SELECT unnest(string_split(risk_reasoning, ' | ')) AS reason FROM ({_RISK}) r) x GROUP BY 1")
register("tk_risk", lambda s, d: risk(_ledger(s, d)).select("account_id", "risk_score", "risk_tier").orderBy(F.desc("risk_score"), "account_id").limit(100), f"SELECT account_id, risk_score, risk_tier FROM ({_RISK}) r ORDER BY risk_score DESC, account_id LIMIT 100")


def _community_risk(s, d):
    return community_risk(_communities(s, d), _records(s, d))


register("ag_community_risk", _community_risk)
register("tk_comm", lambda s, d: _community_risk(s, d).orderBy(F.desc("avg_risk"), "community").limit(50))
