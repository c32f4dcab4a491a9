"""Scores of rows held against labels: thresholds, tiers, confusion, curves, and what becomes of rings and personas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import ORACLES, register
from ..sources.ledger_view import account, legs, table, transfers
from .features import _SHARES, CUT, _clip_sql, against_profile, fitted
from .paths import cycles, edges
from .windows import velocity

#: The upper bounds of the tiers of a score from 0 to 1.
TIERS = {"Very Low": 0.30, "Low": 0.50, "Medium": 0.65, "High": 0.80}


def scored(ledger: DataFrame) -> DataFrame:
    """(leg_id, account_id, score): how far an amount is from its account's mean, from 0 to 1 with five decimals."""
    far = against_profile(ledger, fitted(ledger))
    return far.select("leg_id", "account_id", F.round(F.abs("amount_zscore") / 10, 5).alias("score"))


def threshold(scores: DataFrame, share: float = 0.05) -> DataFrame:
    """One row: the score that the given share of rows reaches.  Scores have five decimals, so there are few different ones."""
    return scores.agg(F.percentile("score", F.lit(1 - share)).alias("threshold"))


def labelled(ledger: DataFrame, personas: DataFrame) -> DataFrame:
    """Scores with a flag from the threshold, the row's and the account's label (bursts), and the account's persona."""
    scores = scored(ledger)
    bursts = velocity(ledger).filter("is_velocity_flag").select("leg_id", "account_id")
    rows = scores.crossJoin(F.broadcast(threshold(scores))).join(bursts.select("leg_id", F.lit(True).alias("is_fraud")), "leg_id", "left")
    rows = rows.join(bursts.groupBy("account_id").agg(F.count("*").alias("bursts")), "account_id", "left").join(personas, "account_id", "left")
    return rows.select("leg_id", "account_id", "score", (F.col("score") >= F.col("threshold")).alias("is_flagged"), F.coalesce("is_fraud", F.lit(False)).alias("is_fraud"), F.col("bursts").isNotNull().alias("acc_is_fraud"), "persona")


def personas(spark, sf_dir) -> DataFrame:
    """(account_id, persona) of all customers."""
    customers = table(spark, sf_dir, "customer")
    n = F.broadcast(customers.agg(F.count("*").alias("n")))
    return customers.crossJoin(n).select(account(F.col("c_custkey") % F.col("n")).alias("account_id"), F.col("c_mktsegment").alias("persona"))


def _labelled(s, d):
    return labelled(legs(s, d), personas(s, d))


_LABELLED = f"""{_SHARES},
per AS (SELECT account_id, avg(CAST(debit + credit AS DOUBLE)) AS mean, stddev_samp(CAST(debit + credit AS DOUBLE)) AS std FROM legs GROUP BY 1),
stats AS (SELECT account_id, mean, coalesce(std, (SELECT quantile_cont(std, 0.5) FROM per), 1.0) AS std FROM per),
scored AS MATERIALIZED (SELECT leg_id, account_id, round(abs({_clip_sql('(CAST(debit + credit AS DOUBLE) - mean) / (std + 1e-9)', -10.0, 10.0)}) / 10, 5) AS score FROM legs JOIN stats USING (account_id)),
top AS (SELECT quantile_cont(score, 0.95) AS threshold FROM scored),
personas AS (SELECT 'A' || lpad(CAST(c_custkey % n AS VARCHAR), 7, '0') AS account_id, c_mktsegment AS persona FROM customer CROSS JOIN n),
labelled AS MATERIALIZED (SELECT s.leg_id, s.account_id, score, score >= threshold AS is_flagged, coalesce(hit, 0) = 1 AS is_fraud, flagged IS NOT NULL AS acc_is_fraud, persona
  FROM scored s CROSS JOIN top LEFT JOIN bursts USING (leg_id) LEFT JOIN flags f ON f.account_id = s.account_id LEFT JOIN personas p ON p.account_id = s.account_id)"""
register("jn_labels", _labelled, f"{_LABELLED} SELECT * FROM labelled")
register(
    "ag_iso_by_account",
    lambda s, d: scored(legs(s, d)).groupBy("account_id").agg(F.round(F.avg("score"), 9).alias("mean_score"), F.max("score").alias("max_score")),
    f"{_LABELLED} SELECT account_id, round(avg(score), 9) AS mean_score, max(score) AS max_score FROM scored GROUP BY 1",
)
register("tk_flagged", lambda s, d: _labelled(s, d).filter("is_flagged").orderBy(F.desc("score"), "leg_id").limit(500).select("leg_id", "account_id", "score"), f"{_LABELLED} SELECT leg_id, account_id, score FROM labelled WHERE is_flagged ORDER BY score DESC, leg_id LIMIT 500")


def tier(score: Column) -> Column:
    case = None
    for name, most in TIERS.items():
        case = F.when(score <= most, name) if case is None else case.when(score <= most, name)
    return case.otherwise("Critical")


def tiered(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Scores stretched by the bounds of the rows that were trained on, with their tier; a new row may lie outside 0 to 1."""
    bounds = train.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    x = F.round((F.col("score") - F.col("low")) / (F.col("high") - F.col("low") + 1e-9), 9)
    return rows.crossJoin(F.broadcast(bounds)).select("leg_id", x.alias("score"), tier(x).alias("tier"))


def _tiers(s, d):
    ledger = legs(s, d)
    scores = scored(ledger)
    return tiered(scores, scores.join(ledger.filter(F.col("date") < CUT).select("leg_id"), "leg_id", "left_semi"))


_TIERED = f"""{_LABELLED}, bounds AS (SELECT min(score) AS low, max(score) AS high FROM scored JOIN legs USING (leg_id) WHERE date < '{CUT}'),
stretched AS (SELECT leg_id, round((score - low) / (high - low + 1e-9), 9) AS score FROM scored CROSS JOIN bounds),
tiers AS (SELECT leg_id, score, CASE WHEN score <= 0.30 THEN 'Very Low' WHEN score <= 0.50 THEN 'Low' WHEN score <= 0.65 THEN 'Medium' WHEN score <= 0.80 THEN 'High' ELSE 'Critical' END AS tier FROM stretched)"""
register("ml_score_tier", _tiers, f"{_TIERED} SELECT * FROM tiers")
register("ag_score_hist", lambda s, d: _tiers(s, d).groupBy("tier").agg(F.count("*").alias("n")), f"{_TIERED} SELECT tier, count(*) AS n FROM tiers GROUP BY 1")


def curve(rows: DataFrame, score: str, truth: str) -> DataFrame:
    """One row a different score: rows and hits at it, and at it or above (n, hits, n_upto, hits_upto, all_hits, all_n).

    The running sums see one row a score, not a row, so a score with few decimals keeps them small at any size.
    """
    points = rows.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), F.count_if(truth).alias("hits"))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return points.withColumns({"n_upto": F.sum("n").over(down), "hits_upto": F.sum("hits").over(down), "all_hits": F.sum("hits").over(whole), "all_n": F.sum("n").over(whole)})


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def confusion(rows: DataFrame, flag: str, truth: str) -> DataFrame:
    """One row: counts, precision, recall and F1 of a flag."""
    f, t = F.col(flag), F.col(truth)
    n = rows.agg(F.count("*").alias("total"), F.count_if(t).alias("actual"), F.count_if(f & t).alias("tp"), F.count_if(f & ~t).alias("fp"), F.count_if(~f & ~t).alias("tn"), F.count_if(~f & t).alias("fn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return n.withColumns({"precision": F.round(_ratio(tp, tp + fp), 4), "recall": F.round(_ratio(tp, tp + fn), 4), "f1": F.round(_ratio(2 * tp, 2 * tp + fp + fn), 4), "caught_pct": F.round(_ratio(tp * 100, tp + fn), 2), "false_alarm_pct": F.round(_ratio(fp * 100, tn + fp), 2)})


def ranking(rows: DataFrame, score: str, truth: str) -> DataFrame:
    """One row: area under the ROC curve (ties count half) and average precision; null without hits or without others."""
    at = curve(rows, score, truth)
    others = F.col("all_n") - F.col("all_hits")
    below = others - (F.col("n_upto") - F.col("hits_upto"))
    wins = F.col("hits") * (below + (F.col("n") - F.col("hits")) / 2) / F.nullif(F.col("all_hits") * others, F.lit(0))
    gain = F.col("hits") / F.nullif("all_hits", F.lit(0)) * F.col("hits_upto") / F.col("n_upto")
    return at.agg(F.round(F.sum(wins), 4).alias("roc_auc"), F.round(F.sum(gain), 4).alias("average_precision"))


def evaluated(rows: DataFrame) -> DataFrame:
    return confusion(rows, "is_flagged", "is_fraud").crossJoin(ranking(rows, "score", "is_fraud"))


def _confusion_sql(source: str, flag: str, truth: str) -> str:
    return f"""(SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1, round(coalesce(tp * 100 / nullif(tp + fn, 0), 0), 2) AS caught_pct, round(coalesce(fp * 100 / nullif(tn + fp, 0), 0), 2) AS false_alarm_pct
  FROM (SELECT count(*) AS total, count(*) FILTER ({truth}) AS actual, count(*) FILTER ({flag} AND {truth}) AS tp, count(*) FILTER ({flag} AND NOT {truth}) AS fp, count(*) FILTER (NOT {flag} AND NOT {truth}) AS tn, count(*) FILTER (NOT {flag} AND {truth}) AS fn FROM {source}) z)"""


register(
    "ag_eval_txn",
    lambda s, d: evaluated(_labelled(s, d)),
    f"""{_LABELLED}, ranks AS (SELECT is_fraud, count(*) OVER (ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, count(*) OVER (PARTITION BY score) AS ties, count(*) OVER (ORDER BY score DESC) AS above, count(*) FILTER (is_fraud) OVER (ORDER BY score DESC) AS hits_above FROM labelled),
auc AS (SELECT round((sum(upto - (ties - 1) / 2) FILTER (is_fraud) - count(*) FILTER (is_fraud) * (count(*) FILTER (is_fraud) + 1) / 2) / (count(*) FILTER (is_fraud) * count(*) FILTER (NOT is_fraud)), 4) AS roc_auc, round(avg(hits_above / above) FILTER (is_fraud), 4) AS average_precision FROM ranks)
SELECT * FROM {_confusion_sql('labelled', 'is_flagged', 'is_fraud')} CROSS JOIN auc""",
)


def best_threshold(rows: DataFrame) -> DataFrame:
    """One row: the threshold of the share of rows, and the lowest score whose rows from it up have the best F1."""
    f1 = 2 * F.col("hits_upto") / (F.col("n_upto") + F.col("all_hits"))
    best = curve(rows, "score", "is_fraud").withColumn("f1", F.round(f1, 9)).agg(F.max(F.struct("f1", -F.col("score"))).alias("best"))
    return threshold(rows).crossJoin(best).select(F.round("threshold", 6).alias("by_share"), (-F.col("best")["col2"]).alias("by_f1"), F.round(F.col("best.f1"), 6).alias("f1"))


register(
    "ml_threshold",
    lambda s, d: best_threshold(_labelled(s, d)),
    f"""{_LABELLED}, points AS (SELECT DISTINCT score, count(*) OVER (ORDER BY score DESC) AS n, count(*) FILTER (is_fraud) OVER (ORDER BY score DESC) AS hits FROM labelled),
f AS (SELECT score, round(2 * hits / (n + (SELECT count(*) FROM labelled WHERE is_fraud)), 9) AS f1 FROM points)
SELECT (SELECT round(threshold, 6) FROM top) AS by_share, score AS by_f1, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, score LIMIT 1""",
)


def by_account(rows: DataFrame) -> DataFrame:
    """(account_id, any_flagged, max_score, n_flagged, n_transactions, acc_is_fraud, persona)."""
    return rows.groupBy("account_id").agg(F.max("is_flagged").alias("any_flagged"), F.max("score").alias("max_score"), F.count_if("is_flagged").alias("n_flagged"), F.count("*").alias("n_transactions"), F.max("acc_is_fraud").alias("acc_is_fraud"), F.max("persona").alias("persona"))


_ACCOUNTS = f"{_LABELLED}, accounts AS (SELECT account_id, bool_or(is_flagged) AS any_flagged, max(score) AS max_score, count(*) FILTER (is_flagged) AS n_flagged, count(*) AS n_transactions, bool_or(acc_is_fraud) AS acc_is_fraud, max(persona) AS persona FROM labelled GROUP BY 1)"
register("ag_eval_acct", lambda s, d: confusion(by_account(_labelled(s, d)), "any_flagged", "acc_is_fraud"), f"{_ACCOUNTS} SELECT * FROM {_confusion_sql('accounts', 'any_flagged', 'acc_is_fraud')}")
register(
    "ag_persona",
    lambda s, d: by_account(_labelled(s, d)).filter(~F.col("acc_is_fraud")).groupBy("persona").agg(F.count("*").alias("total"), F.count_if("any_flagged").alias("flagged")).withColumn("false_positive_pct", F.round(F.col("flagged") / F.col("total") * 100, 1)),
    f"{_ACCOUNTS} SELECT persona, count(*) AS total, count(*) FILTER (any_flagged) AS flagged, round(count(*) FILTER (any_flagged) / count(*) * 100, 1) AS false_positive_pct FROM accounts WHERE NOT acc_is_fraud GROUP BY 1",
)


def rings(found: DataFrame) -> DataFrame:
    """(ring_id, account_id, role_in_ring, amount): every account of every cycle; the account it begins at is the collector."""
    return found.select(F.col("cycle").alias("ring_id"), "seed_account", F.col("closing_amount").alias("amount"), F.explode(F.split("cycle", ">")).alias("account_id")).select("ring_id", "account_id", F.when(F.col("account_id") == F.col("seed_account"), "collector").otherwise("mule").alias("role_in_ring"), "amount")


def _rings(s, d):
    return rings(cycles(edges(transfers(s, d))))


_RINGS = f"rings AS (SELECT cycle AS ring_id, account_id, CASE WHEN account_id = seed_account THEN 'collector' ELSE 'mule' END AS role_in_ring, closing_amount AS amount FROM (SELECT *, unnest(string_split(cycle, '>')) AS account_id FROM ({ORACLES['gr_cycles']}) c) u)"
register("gr_rings", _rings, f"WITH {_RINGS} SELECT * FROM rings")
register(
    "sv_rings",
    lambda s, d: _rings(s, d).groupBy("ring_id").agg(F.count("*").alias("total_accounts"), F.max("amount").alias("total_amount_moved")).orderBy(F.desc("total_amount_moved"), "ring_id").limit(100),
    f"WITH {_RINGS} SELECT ring_id, count(*) AS total_accounts, max(amount) AS total_amount_moved FROM rings GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 100",
)
register("jn_ring_members", lambda s, d: _rings(s, d).join(personas(s, d), "account_id").select("ring_id", "account_id", "role_in_ring", "persona"), f"WITH n AS (SELECT count(*) AS n FROM customer), {_RINGS} SELECT ring_id, account_id, role_in_ring, c_mktsegment AS persona FROM rings JOIN (SELECT 'A' || lpad(CAST(c_custkey % n AS VARCHAR), 7, '0') AS account_id, c_mktsegment FROM customer CROSS JOIN n) p USING (account_id)")


def ring_detection(members: DataFrame, accounts: DataFrame) -> DataFrame:
    """For each ring its accounts, those with a flagged row, their mean top score, and the share found."""
    return members.join(accounts, "account_id").groupBy("ring_id").agg(F.count("*").alias("total_accounts"), F.count_if("any_flagged").alias("detected"), F.round(F.avg("max_score"), 9).alias("avg_max_score")).withColumn("detection_pct", F.round(F.col("detected") / F.col("total_accounts") * 100, 1))


register("ag_ring", lambda s, d: ring_detection(_rings(s, d), by_account(_labelled(s, d))), f"{_ACCOUNTS}, {_RINGS} SELECT ring_id, count(*) AS total_accounts, count(*) FILTER (any_flagged) AS detected, round(avg(max_score), 9) AS avg_max_score, round(count(*) FILTER (any_flagged) / count(*) * 100, 1) AS detection_pct FROM rings JOIN accounts USING (account_id) GROUP BY 1")
