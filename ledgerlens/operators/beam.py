"""Trails by beam: of each way, the two transfers that follow best go on.

A transfer follows within a time of the last one; it is rated by what departs from the way so far: an unknown account,
another reference, another amount, a delay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions.text import is_merchant
from ..plans.fixpoint import checkpointed, dropped
from ..plans.range_join import range_join
from ..sources.ledger_view import written_legs
from .graph import _PARTY, with_outside

#: Results depend on them.
TRAIL = {"hops": 8, "least_ratio": 0.10, "hours": 72, "branches": 2}
PENALTY = {"external": 10_000.0, "reference": 5_000.0, "amount": 2_000.0, "hour": 10.0}
EXITS = ["ATM", "CASH WITHDRAWAL", "CRYPTO", "INTERNATIONAL", "REMITTANCE", "WIRE", "FOREX"]


def trail_edges(ledger: DataFrame) -> DataFrame:
    """(src, dst, amount, leg_id, t, utr_ref, narration): debits, and credits whose sender has no account."""
    accounts = ledger.select(F.col("account_id").alias("cp")).distinct()
    t = F.unix_timestamp("ts").alias("t")
    out = ledger.filter("debit > 0 and cp <> ''").select(F.col("account_id").alias("src"), F.col("cp").alias("dst"), F.col("debit").cast("double").alias("amount"), "leg_id", t, "utr_ref", "narration")
    outside = ledger.filter("credit > 0 and cp <> ''").join(accounts, "cp", "left_anti").select(F.col("cp").alias("src"), F.col("account_id").alias("dst"), F.col("credit").cast("double").alias("amount"), "leg_id", t, "utr_ref", "narration")
    return out.unionByName(outside)


def exits(edges: DataFrame) -> DataFrame:
    """(node, exit): the word of the first transfer out of a node whose narration names a way out of the banks."""
    word = F.coalesce(*(F.when(F.contains(F.upper("narration"), F.lit(w)), w.replace(" ", "_")) for w in EXITS))
    return edges.withColumn("exit", word).filter("exit is not null").groupBy(F.col("src").alias("node")).agg(F.min_by("exit", F.struct("t", "leg_id")).alias("exit"))


def beam_trails(ledger: DataFrame, direction: str = "forward", rules: dict = TRAIL) -> DataFrame:
    """(root, seed_amount, nodes, leg_ids, amount, hops, terminal_type): trails from every account's largest debit, or backward from its largest credit.

    Equal seeds go by time and id; equally rated transfers too.  A way never visits an account twice nor goes through a
    merchant.  It ends outside the known accounts, where no transfer leads on, at a way out of the banks (forward), or
    after the most hops.  Each hop is an equi-join on the account and the bucket of the hop's hours; what follows is picked
    by a way's short id and then joined to the ways, of which only those that ended and those that go on stay written.
    """
    forward = direction == "forward"
    edges = checkpointed(trail_edges(ledger))
    known = checkpointed(ledger.select(F.col("account_id").alias("node")).distinct().withColumn("known", F.lit(True)))
    ahead = edges.select(F.col("src" if forward else "dst").alias("node"), F.col("dst" if forward else "src").alias("to"), F.col("amount").alias("next_amount"), "leg_id", F.col("t").alias("next_t"), F.col("utr_ref").alias("next_ref"))
    ahead = ahead.filter(~is_merchant(F.col("to"))).join(known.select(F.col("node").alias("to"), "known"), "to", "left")
    way_out = exits(edges) if forward else edges.select(F.col("dst").alias("node"), F.lit(None).cast("string").alias("exit")).limit(0)
    open_ended = edges.select(F.col("src" if forward else "dst").alias("node")).distinct().withColumn("goes_on", F.lit(True))
    stops = checkpointed(known.join(open_ended, "node", "left").join(way_out, "node", "left").select(F.col("node").alias("to"), F.when(F.col("goes_on").isNull(), "dead_end").otherwise(F.col("exit")).alias("stop")))
    ahead = checkpointed(ahead.join(stops, "to", "left"))
    side = "debit" if forward else "credit"
    best = ledger.filter(f"{side} > 0").groupBy("account_id").agg(F.min_by(F.struct(F.col(side).cast("double").alias("amount"), F.unix_timestamp("ts").alias("t"), "utr_ref"), F.struct(-F.col(side), "ts", "leg_id")).alias("seed"))
    own_id = F.monotonically_increasing_id().alias("id")
    ways = best.select(own_id, F.col("account_id").alias("root"), F.col("seed.amount").alias("seed_amount"), F.col("account_id").alias("node"), "seed.amount", "seed.t", F.col("seed.utr_ref").alias("ref"), F.array("account_id").alias("nodes"), F.array().cast("array<bigint>").alias("leg_ids"))
    ways, ended = checkpointed(ways), []
    done = [ways, edges, known, stops]
    shown = ["root", "seed_amount", "nodes", "leg_ids", "amount", F.size("leg_ids").cast("long").alias("hops"), "terminal_type"]
    seconds = rules["hours"] * 3600
    for hop in range(1, rules["hops"] + 1):
        mine = ways.select("id", "node", "amount", "t", "ref", "nodes")
        both = range_join(mine, ahead, ["node"], "t", "next_t", seconds) if forward else range_join(ahead, mine, ["node"], "next_t", "t", seconds)
        both = both.filter(~F.array_contains("nodes", F.col("to"))).withColumn("ratio", F.col("next_amount") / F.col("amount")).filter(F.col("ratio") >= rules["least_ratio"])
        same = (F.trim("ref") != "") & (F.trim("ref") == F.trim("next_ref"))
        off = F.when(F.col("known"), 0.0).otherwise(PENALTY["external"]) + F.when(same, 0.0).otherwise(PENALTY["reference"]) + F.abs(F.col("next_amount") - F.col("amount")) / F.col("amount") * PENALTY["amount"] + F.abs(F.col("next_t") - F.col("t")) / 3600.0 * PENALTY["hour"]
        rank = F.row_number().over(Window.partitionBy("id").orderBy("penalty", "next_t", "leg_id"))
        rated = both.select("id", "to", "next_amount", "next_t", "next_ref", "leg_id", "known", "stop", off.alias("penalty"))
        picked = checkpointed(rated.withColumn("rank", rank).filter(F.col("rank") <= rules["branches"]).drop("rank", "penalty"))
        found = F.col("to").isNotNull()
        reason = F.when(~found, "dead_end").when(F.col("known").isNull(), "EXTERNAL_ACCOUNT").otherwise(F.col("stop"))
        went = ways.drop("node", "t", "ref").join(picked, "id", "left" if hop > 1 else "inner")
        went = checkpointed(went.select(own_id, "root", "seed_amount", F.col("to").alias("node"), F.when(found, F.col("next_amount")).otherwise(F.col("amount")).alias("amount"), F.col("next_t").alias("t"), F.col("next_ref").alias("ref"), F.when(found, F.array_append("nodes", F.col("to"))).otherwise(F.col("nodes")).alias("nodes"), F.when(found, F.array_append("leg_ids", F.col("leg_id"))).otherwise(F.col("leg_ids")).alias("leg_ids"), reason.alias("terminal_type")))
        ended.append(checkpointed(went.filter("terminal_type is not null").select(shown)))
        for table in (*done, picked):
            dropped(table)
        ways, done = went.filter("terminal_type is null").drop("terminal_type"), [went]
    ended.append(ways.withColumn("terminal_type", F.lit("max_hops_reached")).select(shown))
    return reduce(DataFrame.unionByName, ended)


#: In the queries a few narrations name a way out.
_TOLD = "CASE WHEN rid % 1009 = 0 THEN concat('INTERNATIONAL ', utr_ref) WHEN rid % 797 = 0 THEN concat('atm ', utr_ref) ELSE concat('PAY ', utr_ref) END"


def _beam_sql(direction: str) -> str:
    from ..sources.ledger_view import LEGS_SQL

    fwd = direction == "forward"
    a, b, side = ("src", "dst", "debit") if fwd else ("dst", "src", "credit")
    within = "e.t BETWEEN w.t AND w.t + 259200" if fwd else "e.t BETWEEN w.t - 259200 AND w.t"
    words = " ".join(f"WHEN contains(upper(narration), '{w}') THEN '{w.replace(' ', '_')}'" for w in EXITS)
    return f"""WITH RECURSIVE {LEGS_SQL},
known AS (SELECT * REPLACE ({_PARTY} AS cp, {_TOLD} AS narration, CAST(epoch(ts) AS BIGINT) AS ts) FROM legs),
own AS (SELECT DISTINCT account_id FROM known),
e AS MATERIALIZED (SELECT account_id AS src, cp AS dst, CAST(debit AS DOUBLE) AS amount, leg_id, ts AS t, utr_ref, narration FROM known WHERE debit > 0
  UNION ALL SELECT cp, account_id, CAST(credit AS DOUBLE), leg_id, ts, utr_ref, narration FROM known WHERE credit > 0 AND cp NOT IN (SELECT account_id FROM own)),
exits AS (SELECT src AS node, arg_min(word, (t, leg_id)) AS word FROM (SELECT *, CASE {words} END AS word FROM e) z WHERE word IS NOT NULL GROUP BY 1),
ahead AS MATERIALIZED (SELECT e.{a} AS node, e.{b} AS dest, amount, leg_id, t, utr_ref, o.account_id IS NOT NULL AS inside, CASE WHEN e.{b} NOT IN (SELECT {a} FROM e) THEN 'dead_end' {"ELSE x.word" if fwd else ""} END AS stop
  FROM e LEFT JOIN own o ON o.account_id = e.{b} LEFT JOIN exits x ON x.node = e.{b}),
ways AS (SELECT account_id AS root, CAST({side} AS DOUBLE) AS seed_amount, account_id AS node, CAST({side} AS DOUBLE) AS amount, ts AS t, utr_ref AS ref, [account_id] AS nodes, CAST([] AS BIGINT[]) AS leg_ids, CAST(NULL AS VARCHAR) AS stop, 0 AS hop
    FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY {side} DESC, ts, leg_id) AS k FROM known WHERE {side} > 0) s WHERE k = 1
  UNION ALL SELECT root, seed_amount, dest, next_amount, next_t, next_ref, list_append(nodes, dest), list_append(leg_ids, leg_id), CASE WHEN NOT inside THEN 'EXTERNAL_ACCOUNT' ELSE next_stop END, hop + 1
  FROM (SELECT w.*, e.dest, e.amount AS next_amount, e.t AS next_t, e.utr_ref AS next_ref, e.leg_id, e.inside, e.stop AS next_stop,
      row_number() OVER (PARTITION BY w.root, w.leg_ids ORDER BY (CASE WHEN inside THEN 0.0::DOUBLE ELSE 10000.0::DOUBLE END) + (CASE WHEN w.ref = e.utr_ref THEN 0.0::DOUBLE ELSE 5000.0::DOUBLE END) + abs(e.amount - w.amount) / w.amount * 2000.0::DOUBLE + abs(e.t - w.t) / 3600.0::DOUBLE * 10.0::DOUBLE, e.t, e.leg_id) AS k
    FROM ways w JOIN ahead e ON e.node = w.node AND {within} AND NOT list_contains(w.nodes, e.dest) AND e.amount / w.amount >= 0.1::DOUBLE WHERE w.stop IS NULL AND w.hop < 8) z WHERE k <= 2),
ended AS (SELECT root, seed_amount, nodes, leg_ids, amount, hop AS hops, CASE WHEN stop IS NOT NULL THEN stop WHEN hop = 8 THEN 'max_hops_reached' ELSE 'dead_end' END AS terminal_type
  FROM ways w WHERE hop > 0 AND (stop IS NOT NULL OR hop = 8 OR NOT EXISTS (SELECT 1 FROM ways n WHERE n.hop = w.hop + 1 AND n.root = w.root AND n.leg_ids[:w.hop] = w.leg_ids)))"""


def _beam(s, d, direction):
    return beam_trails(with_outside(written_legs(s, d)).withColumn("narration", F.expr(_TOLD)), direction)


for _name, _direction in (("tr_bfs_fwd", "forward"), ("tr_bfs_bwd", "backward")):
    register(
        _name,
        lambda s, d, w=_direction: _beam(s, d, w).select("root", "seed_amount", F.array_join("nodes", ">").alias("nodes"), F.array_join("leg_ids", ">").alias("leg_ids"), "amount", "hops", "terminal_type"),
        f"{_beam_sql(_direction)} SELECT root, seed_amount, array_to_string(nodes, '>') AS nodes, array_to_string(leg_ids, '>') AS leg_ids, amount, CAST(hops AS BIGINT) AS hops, terminal_type FROM ended",
    )
register(
    "tk_beam",
    lambda s, d: _beam(s, d, "forward").groupBy("root", "terminal_type").agg(F.count("*").alias("n_trails"), F.max("hops").alias("longest"), F.max("amount").alias("most_recovered")),
    f"{_beam_sql('forward')} SELECT root, terminal_type, count(*) AS n_trails, CAST(max(hops) AS BIGINT) AS longest, max(amount) AS most_recovered FROM ended GROUP BY 1, 2",
)
