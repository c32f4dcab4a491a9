"""Round trips, layering chains and cycles: joins over time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..plans.fixpoint import checkpointed
from ..plans.iterate import iterate_paths
from ..plans.range_join import range_join
from ..schema import CYCLE, LAYERING, ROUND_TRIP, day, epoch
from ..sources.ledger_view import LEGS_SQL, TRANSFERS_SQL, legs, transfers
from .windows import floors


def round_trips(ledger: DataFrame) -> DataFrame:
    """For large debits the credit from the same party within thirty days that is nearest in amount; three a pair."""
    rule = ROUND_TRIP
    out = ledger.filter((F.col("debit") > 0) & (F.col("cp") != ""))
    out = out.join(floors(out, "debit", rule["quantile"]), "account_id").filter(F.col("debit").cast("double") >= F.col("floor"))
    left = out.select("account_id", "cp", F.col("leg_id").alias("out_id"), F.col("debit").alias("out_amt"), epoch(F.col("ts")).alias("out_t"), F.col("ts").alias("out_ts"))
    right = ledger.filter("credit > 0").select("account_id", "cp", F.col("leg_id").alias("back_id"), F.col("credit").alias("back_amt"), epoch(F.col("ts")).alias("back_t"), F.col("ts").alias("back_ts"))
    pairs = range_join(left, right, ["account_id", "cp"], "out_t", "back_t", rule["days"] * 86400).filter("back_t > out_t")
    near = pairs.filter((F.col("back_amt") >= F.col("out_amt") * F.lit(rule["low"]).cast("decimal(3,2)")) & (F.col("back_amt") <= F.col("out_amt") * F.lit(rule["high"]).cast("decimal(3,2)")))
    best = near.groupBy("account_id", "cp", "out_id", "out_amt", "out_t", "out_ts").agg(F.min_by(F.struct("back_amt", "back_t", "back_ts"), F.struct(F.abs(F.col("back_amt") - F.col("out_amt")), "back_t", "back_id")).alias("b"))
    kept = best.withColumn("k", F.row_number().over(Window.partitionBy("account_id", "cp").orderBy("out_t", "out_id"))).filter(F.col("k") <= rule["per_pair"])
    gap = F.col("b.back_t") - F.col("out_t")
    return kept.select(
        F.col("account_id").alias("account_a"), F.col("cp").alias("account_b"), F.col("out_amt").cast("double").alias("outflow_amount"), F.col("b.back_amt").cast("double").alias("return_amount"),
        F.round(F.col("b.back_amt").cast("double") / F.col("out_amt").cast("double"), 4).alias("return_ratio"), day(F.col("out_ts")).alias("outflow_date"), day(F.col("b.back_ts")).alias("return_date"),
        F.round(gap / 86400, 4).alias("gap_days"), F.when(gap <= 3 * 86400, "HIGH").otherwise("MEDIUM").alias("severity"),
    )


register(
    "jn_ts_range",
    lambda s, d: round_trips(legs(s, d)),
    f"""WITH {LEGS_SQL},
floors AS (SELECT account_id, quantile_cont(CAST(debit AS DOUBLE), 0.6) AS floor FROM legs WHERE debit > 0 GROUP BY 1),
outs AS (SELECT legs.* FROM legs JOIN floors USING (account_id) WHERE debit > 0 AND CAST(debit AS DOUBLE) >= floor),
pairs AS (SELECT o.account_id, o.cp, o.leg_id, o.debit, o.ts, b.credit, b.ts AS back, row_number() OVER (PARTITION BY o.leg_id ORDER BY abs(b.credit - o.debit), b.ts, b.leg_id) AS r
  FROM outs o JOIN legs b ON o.account_id = b.account_id AND o.cp = b.cp AND b.credit > 0 AND b.ts > o.ts AND b.ts <= o.ts + INTERVAL 30 DAY AND b.credit >= o.debit * 0.65 AND b.credit <= o.debit * 1.35),
kept AS (SELECT *, row_number() OVER (PARTITION BY account_id, cp ORDER BY ts, leg_id) AS k FROM pairs WHERE r = 1)
SELECT account_id AS account_a, cp AS account_b, CAST(debit AS DOUBLE) AS outflow_amount, CAST(credit AS DOUBLE) AS return_amount, round(CAST(credit AS DOUBLE) / CAST(debit AS DOUBLE), 4) AS return_ratio,
  strftime(ts, '%Y-%m-%d') AS outflow_date, strftime(back, '%Y-%m-%d') AS return_date, round((epoch(back) - epoch(ts)) / 86400, 4) AS gap_days, CASE WHEN back - ts <= INTERVAL 3 DAY THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM kept WHERE k <= 3""",
)


def edges(ts: DataFrame) -> DataFrame:
    from ..sources.ledger_view import account

    return ts.select(account(F.col("src")).alias("src"), account(F.col("dst")).alias("dst"), "amt", F.unix_timestamp("ts").alias("t"), "rid")


def layering(edges: DataFrame) -> DataFrame:
    """Chains of three to six large transfers over distinct accounts, at most 72 hours and half the amount lost between them.

    The floor is the global quantile of transfer amounts: one number, so it joins as one broadcast row.
    """
    rule = LAYERING
    floor = edges.filter("amt > 0").agg(F.percentile(F.col("amt").cast("double"), F.lit(rule["quantile"])).alias("floor"))
    large = edges.crossJoin(F.broadcast(floor)).filter(F.col("amt").cast("double") >= F.col("floor")).drop("floor")
    step = lambda a, t, b, u: (u >= t) & (u - t <= rule["hop_hours"] * 3600) & (b >= a * F.lit(rule["keep"]).cast("decimal(3,2)"))
    found = [p for k, p in enumerate(iterate_paths(large, rule["max_chain"], step, rule["hop_hours"] * 3600), 1) if k >= rule["min_chain"]]
    return reduce(DataFrame.unionByName, found)


def chain_rows(paths: DataFrame) -> DataFrame:
    n = F.size("amts")
    start, end = F.element_at("amts", 1).cast("double"), F.element_at("amts", -1).cast("double")
    stamp = lambda k: F.date_format(F.timestamp_seconds(F.element_at("times", k)), "yyyy-MM-dd")
    return paths.select(F.array_join("nodes", ">").alias("chain"), n.cast("long").alias("chain_length"), start.alias("start_amount"), end.alias("end_amount"), F.round(end / start, 4).alias("skim_ratio"), stamp(1).alias("start_date"), stamp(-1).alias("end_date"), F.when(n >= 5, "CRITICAL").otherwise("HIGH").alias("severity"), F.array_join(F.col("rids").cast("array<string>"), ",").alias("rids"))


_EDGES_SQL = f"""WITH RECURSIVE {TRANSFERS_SQL},
edges AS (SELECT 'A' || lpad(CAST(src AS VARCHAR), 7, '0') AS src, 'A' || lpad(CAST(dst AS VARCHAR), 7, '0') AS dst, amt, epoch(ts)::BIGINT AS t, rid FROM transfers)"""

register(
    "gr_layering",
    lambda s, d: chain_rows(layering(edges(transfers(s, d)))),
    f"""{_EDGES_SQL},
large AS MATERIALIZED (SELECT * FROM edges WHERE CAST(amt AS DOUBLE) >= (SELECT quantile_cont(CAST(amt AS DOUBLE), 0.6) FROM edges)),
paths AS (SELECT [src, dst] AS nodes, [amt] AS amts, [t] AS times, [rid] AS rids, dst AS last, 1 AS n FROM large
  UNION ALL SELECT list_append(nodes, e.dst), list_append(amts, e.amt), list_append(times, e.t), list_append(rids, e.rid), e.dst, n + 1 FROM paths p JOIN large e ON e.src = p.last
    AND e.t >= p.times[-1] AND e.t - p.times[-1] <= 259200 AND e.amt >= p.amts[-1] * 0.5 AND NOT list_contains(nodes, e.dst) WHERE n < 6)
SELECT array_to_string(nodes, '>') AS chain, CAST(n AS BIGINT) AS chain_length, CAST(amts[1] AS DOUBLE) AS start_amount, CAST(amts[-1] AS DOUBLE) AS end_amount, round(CAST(amts[-1] AS DOUBLE) / CAST(amts[1] AS DOUBLE), 4) AS skim_ratio,
  strftime(make_timestamp(times[1] * 1000000), '%Y-%m-%d') AS start_date, strftime(make_timestamp(times[-1] * 1000000), '%Y-%m-%d') AS end_date, CASE WHEN n >= 5 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, array_to_string(rids, ',') AS rids FROM paths WHERE n >= 3""",
)


def _closed(out: DataFrame, home: DataFrame, links: int, step, hop: int, rule: dict) -> DataFrame:
    """(nodes, first, seed_amt, close_amt, t, close_t, rids) of paths `out` that a path `home` of `links` transfers continues to where they began."""
    inner = lambda c: F.slice(c, F.lit(2), F.lit(links - 1))
    # Long buckets: a path home stands in a second one only where it could follow across their border.
    bucket = lambda t: F.floor(t / (8 * hop))
    a = out.select("first", "last", F.col("nodes").alias("a_nodes"), F.get("amts", 0).alias("seed_amt"), F.element_at("amts", -1).alias("mid_amt"), F.get("times", 0).alias("t"), F.element_at("times", -1).alias("mid_t"), F.col("rids").alias("a_rids")).withColumn("at", bucket(F.col("mid_t")))
    # A transfer to the account itself can only be the first of all.
    b = home.filter(F.get("nodes", 0) != F.get("nodes", 1)).select(F.col("first").alias("last"), F.col("last").alias("first"), inner("nodes").alias("b_nodes"), F.get("amts", 0).alias("next_amt"), F.element_at("amts", -1).alias("close_amt"), F.get("times", 0).alias("next_t"), F.element_at("times", -1).alias("close_t"), F.col("rids").alias("b_rids"))
    b = b.withColumn("at", F.explode(F.array_distinct(F.array(bucket(F.col("next_t") - hop), bucket(F.col("next_t"))))))
    bound = lambda name: F.col("seed_amt") * F.lit(rule[name]).cast("decimal(3,2)")
    ratio = (F.col("close_amt") >= bound("close_low")) & (F.col("close_amt") <= bound("close_high"))
    whole_days = F.floor((F.col("close_t") - F.col("t")) / 86400) <= rule["days"]
    met = a.join(b, ["first", "last", "at"]).filter(step(F.col("mid_amt"), F.col("mid_t"), F.col("next_amt"), F.col("next_t")) & ratio & whole_days)
    met = met if links == 1 else met.filter(~F.arrays_overlap("a_nodes", "b_nodes"))
    return met.select(F.concat("a_nodes", "b_nodes").alias("nodes"), "first", "seed_amt", "close_amt", "t", "close_t", F.concat("a_rids", "b_rids").alias("rids"))


def cycles(edges: DataFrame) -> DataFrame:
    """Three to six transfers that lead back to where they began: later and later, hop by hop keeping most of the amount.

    A cycle is a path and another from its end back to its start, each of half the transfers, so paths of more than three
    transfers, of which most never close, are not made.
    """
    rule = CYCLE
    amounts = edges.groupBy("src").agg(F.count("*").alias("n"), F.percentile(F.col("amt").cast("double"), F.lit(rule["quantile"])).alias("q"))
    floor = amounts.select("src", F.when(F.col("n") >= rule["floor_from"], F.col("q")).otherwise(0.0).alias("floor"))
    usable = edges.join(floor, "src").filter(F.col("amt").cast("double") >= F.col("floor")).drop("floor")
    keep, hop = F.lit(rule["keep"]).cast("decimal(3,2)"), rule["hop_hours"] * 3600
    step = lambda a, t, b, u: (u > t) & (u - t <= rule["hop_hours"] * 3600) & (b >= a * keep)
    most = (rule["max_hops"] + 1) // 2
    paths = dict(enumerate(iterate_paths(usable, most, step, hop), 1))
    found = [checkpointed(_closed(paths[n - n // 2], paths[n // 2], n // 2, step, hop, rule)) for n in range(rule["min_hops"], rule["max_hops"] + 1)]
    every = reduce(DataFrame.unionByName, found)
    # One row a rotation: the earliest start of the same transfers' accounts, by time, then ids.
    at = F.array_position("nodes", F.array_min("nodes")).cast("int")
    turned = F.concat(F.slice("nodes", at, F.size("nodes")), F.slice("nodes", F.lit(1), at - 1))
    best = every.withColumn("turned", turned).groupBy("turned").agg(F.min_by(F.struct(F.size("nodes").alias("n"), "first", "seed_amt", "close_amt", "t", "close_t"), F.struct("t", "rids")).alias("best"))
    first = best.select(F.array_join("turned", ">").alias("cycle"), "best.*")
    n = F.col("n")
    seed, close = F.col("seed_amt").cast("double"), F.col("close_amt").cast("double")
    return first.select(n.cast("long").alias("hop_count"), "cycle", F.col("first").alias("seed_account"), seed.alias("seed_amount"), close.alias("closing_amount"), F.round(close / seed, 4).alias("closing_ratio"), F.round((F.col("close_t") - F.col("t")) / 86400, 4).alias("elapsed_days"), F.when(n >= 4, "CRITICAL").otherwise("HIGH").alias("severity"))


register(
    "gr_cycles",
    lambda s, d: cycles(edges(transfers(s, d))),
    f"""{_EDGES_SQL},
floors AS (SELECT src, CASE WHEN count(*) >= 5 THEN quantile_cont(CAST(amt AS DOUBLE), 0.2) ELSE 0 END AS floor FROM edges GROUP BY 1),
usable AS MATERIALIZED (SELECT edges.* FROM edges JOIN floors USING (src) WHERE CAST(amt AS DOUBLE) >= floor),
paths AS (SELECT src AS first, [src, dst] AS nodes, [amt] AS amts, [t] AS times, [rid] AS rids, dst AS last, 1 AS n FROM usable
  UNION ALL SELECT first, list_append(nodes, e.dst), list_append(amts, e.amt), list_append(times, e.t), list_append(rids, e.rid), e.dst, n + 1 FROM paths p JOIN usable e ON e.src = p.last
    AND e.t > p.times[-1] AND e.t - p.times[-1] <= 345600 AND e.amt >= p.amts[-1] * 0.55 AND NOT list_contains(nodes, e.dst) WHERE n < 5),
closed AS (SELECT p.*, e.amt AS ca, e.t AS ct, list_append(rids, e.rid) AS all_rids, list_position(nodes, list_min(nodes)) AS pos FROM paths p JOIN usable e ON e.src = p.last AND e.dst = p.first AND e.t > p.times[-1] AND e.t - p.times[-1] <= 345600
    AND e.amt >= p.amts[-1] * 0.55 AND e.amt >= p.amts[1] * 0.55 AND e.amt <= p.amts[1] * 1.45 AND (e.t - p.times[1]) // 86400 <= 45 WHERE n >= 2),
turned AS (SELECT *, list_concat(nodes[pos:len(nodes)], nodes[1:pos - 1]) AS cycle FROM closed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY times[1], all_rids) AS k FROM turned)
SELECT CAST(n + 1 AS BIGINT) AS hop_count, array_to_string(cycle, '>') AS cycle, first AS seed_account, CAST(amts[1] AS DOUBLE) AS seed_amount, CAST(ca AS DOUBLE) AS closing_amount, round(CAST(ca AS DOUBLE) / CAST(amts[1] AS DOUBLE), 4) AS closing_ratio,
  round((ct - times[1]) / 86400, 4) AS elapsed_days, CASE WHEN n + 1 >= 4 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM ranked WHERE k = 1""",
)
