"""Features of rows against frozen statistics of accounts, scores and tiers, and small joins and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..sources.ledger_view import BALANCED_SQL, LEGS_SQL, balanced, legs
from .risk import count_score, risk_tier, segments
from .windows import by_account, in_order, iqr_outliers, velocity


def amount():
    return (F.col("debit") + F.col("credit")).cast("double")


def clipped(x, low: float, high: float, digits: int = 4):
    """x within bounds, rounded; never a negative zero."""
    y = F.round(F.greatest(F.least(x, F.lit(high)), F.lit(low)), digits)
    return F.when(y == 0, 0.0).otherwise(y)


def _clip_sql(x: str, low: float, high: float) -> str:
    return f"CASE WHEN round(greatest(least({x}, {high}), {low}), 4) = 0 THEN 0.0 ELSE round(greatest(least({x}, {high}), {low}), 4) END"


def fitted(ledger: DataFrame) -> DataFrame:
    """(account_id, mean, std) of amounts; an account with one row has the median of the others' spreads, or 1."""
    per = ledger.groupBy("account_id").agg(F.avg(amount()).alias("mean"), F.stddev_samp(amount()).alias("std"))
    middle = per.agg(F.percentile("std", F.lit(0.5)).alias("middle"))
    return per.crossJoin(F.broadcast(middle)).select("account_id", "mean", F.coalesce("std", "middle", F.lit(1.0)).alias("std"))


def fallback(stats: DataFrame) -> DataFrame:
    """One row: the means of the accounts' statistics, for accounts that weren't fitted on."""
    return stats.agg(F.avg("mean").alias("mean_all"), F.avg("std").alias("std_all"))


def against_profile(ledger: DataFrame, stats: DataFrame) -> DataFrame:
    """Each row's distance from its account's frozen mean in spreads; unseen accounts take the fallback row."""
    rows = ledger.join(stats, "account_id", "left").crossJoin(F.broadcast(fallback(stats)))
    z = (amount() - F.coalesce("mean", "mean_all")) / (F.coalesce("std", "std_all") + 1e-9)
    return rows.select("leg_id", "account_id", clipped(z, -10.0, 10.0).alias("amount_zscore"))


#: Rows before this day are fitted on in the queries.
CUT = "2024-01-10"
_FIT = f"""WITH {LEGS_SQL},
per AS (SELECT account_id, avg(CAST(debit + credit AS DOUBLE)) AS mean, stddev_samp(CAST(debit + credit AS DOUBLE)) AS std FROM legs WHERE date < '{CUT}' GROUP BY 1),
stats AS (SELECT account_id, mean, coalesce(std, (SELECT quantile_cont(std, 0.5) FROM per), 1.0) AS std FROM per),
fb AS (SELECT avg(mean) AS mean_all, avg(std) AS std_all FROM stats)"""


def _train(s, d):
    return fitted(legs(s, d).filter(F.col("date") < CUT))


register("ag_fallback_row", lambda s, d: fallback(_train(s, d)).select(F.round("mean_all", 4).alias("mean_all"), F.round("std_all", 4).alias("std_all")), f"{_FIT} SELECT round(mean_all, 4) AS mean_all, round(std_all, 4) AS std_all FROM fb")
register(
    "jn_account_profile",
    lambda s, d: against_profile(legs(s, d).filter(F.col("date") >= CUT), _train(s, d)),
    f"{_FIT} SELECT leg_id, account_id, {_clip_sql('(CAST(debit + credit AS DOUBLE) - coalesce(mean, mean_all)) / (coalesce(std, std_all) + 1e-9)', -10.0, 10.0)} AS amount_zscore FROM legs LEFT JOIN stats USING (account_id) CROSS JOIN fb WHERE date >= '{CUT}'",
)
register(
    "jn_unseen",
    lambda s, d: legs(s, d).filter(F.col("date") >= CUT).select("account_id").distinct().join(_train(s, d), "account_id", "left_anti"),
    f"{_FIT} SELECT DISTINCT account_id FROM legs WHERE date >= '{CUT}' AND account_id NOT IN (SELECT account_id FROM stats)",
)


def balance_features(ledger: DataFrame) -> DataFrame:
    """Distance from the account's mean balance, low balances, the drop since the row before, and relative spread."""
    b = F.col("balance").cast("double")
    rows = ledger.withColumns({"b": b, "before": F.lag(b).over(in_order()), "mean": F.avg(b).over(by_account()), "std": F.stddev_samp(b).over(by_account())})
    middle = ledger.groupBy("account_id").agg(F.stddev_samp(b).alias("std")).agg(F.percentile("std", F.lit(0.5)).alias("middle"))
    rows = rows.crossJoin(F.broadcast(middle)).withColumn("std", F.coalesce("std", "middle", F.lit(1.0)))
    drop = F.coalesce((F.col("before") - F.col("b")) / (F.abs("before") + 1e-9), F.lit(0.0))
    return rows.select(
        "leg_id",
        F.when(F.col("b").isNotNull(), clipped((F.col("b") - F.col("mean")) / (F.col("std") + 1e-9), -10.0, 10.0)).alias("balance_zscore"),
        F.coalesce(F.col("b") < 500, F.lit(False)).alias("near_zero_balance"),
        clipped(drop, -5.0, 5.0).alias("balance_drop_pct"),
        clipped(F.col("std") / (F.abs("mean") + 1e-9), 0.0, 10.0).alias("balance_cv"),
    )


register(
    "wn_balance_feat",
    lambda s, d: balance_features(balanced(legs(s, d))),
    f"""WITH {BALANCED_SQL},
b AS (SELECT *, CAST(balance AS DOUBLE) AS b FROM ledger),
per AS (SELECT account_id, avg(b) AS mean, stddev_samp(b) AS std FROM b GROUP BY 1),
f AS (SELECT account_id, mean, coalesce(std, (SELECT quantile_cont(std, 0.5) FROM per), 1.0) AS std FROM per),
x AS (SELECT leg_id, account_id, b, lag(b) OVER (PARTITION BY account_id ORDER BY ts, leg_id) AS before FROM b)
SELECT leg_id, CASE WHEN b IS NOT NULL THEN {_clip_sql('(b - mean) / (std + 1e-9)', -10.0, 10.0)} END AS balance_zscore, coalesce(b < 500, false) AS near_zero_balance,
  {_clip_sql('coalesce((before - b) / (abs(before) + 1e-9), 0.0)', -5.0, 5.0)} AS balance_drop_pct, {_clip_sql('std / (abs(mean) + 1e-9)', 0.0, 10.0)} AS balance_cv FROM x JOIN f USING (account_id)""",
)


def flag_shares(ledger: DataFrame) -> DataFrame:
    """Rows of each account, those in bursts, and their share in percent."""
    bursts = velocity(ledger).filter("is_velocity_flag").groupBy("account_id").agg(F.count("*").alias("flagged"))
    per = ledger.groupBy("account_id").agg(F.count("*").alias("total_txns")).join(bursts, "account_id", "left")
    flagged = F.coalesce("flagged", F.lit(0))
    return per.select("account_id", "total_txns", flagged.alias("flagged_txns"), F.round(flagged / F.col("total_txns") * 100, 1).alias("flag_pct"))


_SHARES = f"""WITH {LEGS_SQL},
anchors AS (SELECT *, count(*) OVER (PARTITION BY account_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 30 MINUTE FOLLOWING) AS n FROM legs WHERE time <> '00:00:00'),
bursts AS (SELECT leg_id, account_id, max(CASE WHEN n >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) AS hit FROM anchors),
flags AS (SELECT account_id, count(*) AS flagged FROM bursts WHERE hit = 1 GROUP BY 1),
shares AS (SELECT account_id, count(*) AS total_txns, coalesce(any_value(flagged), 0) AS flagged_txns, round(coalesce(any_value(flagged), 0) / count(*) * 100, 1) AS flag_pct FROM legs LEFT JOIN flags USING (account_id) GROUP BY 1)"""
register("ag_flag_pct", lambda s, d: flag_shares(legs(s, d)), f"{_SHARES} SELECT * FROM shares")
register(
    "fn_count_score",
    lambda s, d: flag_shares(legs(s, d)).select("account_id", F.round(count_score(F.col("flagged_txns")), 6).alias("count_score")),
    f"{_SHARES} SELECT account_id, round(least(ln(1 + flagged_txns) / ln(6), 1.0), 6) AS count_score FROM shares",
)
register(
    "fn_rate_score",
    lambda s, d: flag_shares(legs(s, d)).select("account_id", F.round(F.least(F.sqrt(F.col("flagged_txns") / F.col("total_txns")), F.lit(1.0)), 6).alias("rate_score")),
    f"{_SHARES} SELECT account_id, round(least(sqrt(flagged_txns / total_txns), 1.0), 6) AS rate_score FROM shares",
)


def _scores(s, d):
    return flag_shares(legs(s, d)).select("account_id", F.round(count_score(F.col("flagged_txns")) * 100, 1).alias("score"))


_SCORES = f"{_SHARES}, scores AS (SELECT account_id, round(least(ln(1 + flagged_txns) / ln(6), 1.0) * 100, 1) AS score FROM shares)"
_TIER = "CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END"
_LOW_TIER = "CASE WHEN score >= 45 THEN 'CRITICAL' WHEN score >= 30 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END"
register("fn_tier", lambda s, d: _scores(s, d).select("account_id", risk_tier(F.col("score"), F.lit(True)).alias("tier")), f"{_SCORES} SELECT account_id, {_TIER} AS tier FROM scores")
register(
    "fn_tier_fallback",
    lambda s, d: (lambda x: x.crossJoin(F.broadcast(x.agg((F.max("score") >= 50).alias("seen")))).select("account_id", risk_tier(F.col("score"), F.col("seen")).alias("tier")))(_scores(s, d).filter("score < 50")),
    f"{_SCORES}, low AS (SELECT * FROM scores WHERE score < 50) SELECT account_id, {_LOW_TIER} AS tier FROM low",
)


def service_edges(ledger: DataFrame) -> DataFrame:
    """Sums by direction, channel, day and reference; of both directions of a pair, channel and day, the first stays."""
    sums = ledger.groupBy("account_id", "cp", "channel", "date", "utr_ref").agg(F.sum(F.col("debit") + F.col("credit")).alias("total"))
    pair = Window.partitionBy(F.least("account_id", "cp"), F.greatest("account_id", "cp"), "channel", "date").orderBy("account_id", "utr_ref")
    return sums.withColumn("k", F.row_number().over(pair)).filter("k = 1").select(F.col("utr_ref").alias("id"), F.col("account_id").alias("source"), F.col("cp").alias("target"), F.col("total").cast("double").alias("amount"), "channel", "date")


register(
    "ag_db_edges",
    lambda s, d: service_edges(legs(s, d)),
    f"""WITH {LEGS_SQL}, sums AS (SELECT account_id, cp, channel, date, utr_ref, sum(debit + credit) AS total FROM legs GROUP BY 1, 2, 3, 4, 5),
ranked AS (SELECT *, row_number() OVER (PARTITION BY least(account_id, cp), greatest(account_id, cp), channel, date ORDER BY account_id, utr_ref) AS k FROM sums)
SELECT utr_ref AS id, account_id AS source, cp AS target, CAST(total AS DOUBLE) AS amount, channel, date FROM ranked WHERE k = 1""",
)
register(
    "norm_running_balance",
    lambda s, d: legs(s, d).select("leg_id", F.sum(F.col("credit") - F.col("debit")).over(in_order().rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("balance")),
    f"WITH {LEGS_SQL} SELECT leg_id, CAST(sum(credit - debit) OVER (PARTITION BY account_id ORDER BY ts, leg_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance FROM legs",
)
register(
    "flt_graph_sliders",
    lambda s, d: legs(s, d).filter((F.greatest("debit", "credit") >= 20000) & F.col("date").between("2024-01-15", "2024-02-15")).select("leg_id", "account_id", "cp"),
    f"WITH {LEGS_SQL} SELECT leg_id, account_id, cp FROM legs WHERE greatest(debit, credit) >= 20000 AND date BETWEEN '2024-01-15' AND '2024-02-15'",
)
register(
    "jn_pair_freq",
    lambda s, d: legs(s, d).select("leg_id", F.count("*").over(Window.partitionBy("account_id", "cp")).alias("cp_freq")),
    f"WITH {LEGS_SQL} SELECT leg_id, count(*) OVER (PARTITION BY account_id, cp) AS cp_freq FROM legs",
)
register(
    "jn_segment",
    lambda s, d: legs(s, d).select("leg_id", "account_id").join(segments(legs(s, d), txns=30.0), "account_id", "left"),
    f"WITH {LEGS_SQL}, p AS (SELECT account_id, CAST(sum(debit + credit) AS DOUBLE) AS total, count(*) AS n, greatest(1, floor((epoch(max(ts)) - epoch(min(ts))) / 86400)) AS days FROM legs GROUP BY 1), seg AS (SELECT account_id, CASE WHEN total / (days / 30) >= 500000 AND n / (days / 30) >= 30 AND total / n >= 5000 THEN 'business' ELSE 'retail' END AS entity_segment FROM p) SELECT leg_id, account_id, entity_segment FROM legs LEFT JOIN seg USING (account_id)",
)
_SELF = "CASE WHEN rid % 37 = 0 THEN account_id ELSE cp END"
register("flt_self_transfer", lambda s, d: legs(s, d).withColumn("cp", F.expr(_SELF)).filter("cp = account_id").select("leg_id", "account_id"), f"WITH {LEGS_SQL}, x AS (SELECT leg_id, account_id, {_SELF} AS party FROM legs) SELECT leg_id, account_id FROM x WHERE party = account_id")
_STAMP = "CASE CAST(rid % 4 AS INT) WHEN 0 THEN time WHEN 1 THEN concat('at ', substr(time, 1, 5)) WHEN 2 THEN concat(date, ' ', substr(time, 2, 7)) ELSE date END"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2}))?"


def clock(text):
    """HH:MM:SS of the first time in a text, midnight where there is none."""
    part = lambda k: F.regexp_extract(text, _CLOCK, k)
    return F.when(part(2) == "", "00:00:00").otherwise(F.concat_ws(":", F.lpad(part(1), 2, "0"), part(2), F.coalesce(F.nullif(part(3), F.lit("")), F.lit("00"))))


register(
    "fn_extract_time",
    lambda s, d: legs(s, d).select("leg_id", clock(F.expr(_STAMP)).alias("clock")),
    f"WITH {LEGS_SQL}, x AS (SELECT leg_id, {_STAMP} AS t FROM legs) SELECT leg_id, CASE WHEN regexp_extract(t, '{_CLOCK}', 2) = '' THEN '00:00:00' ELSE lpad(regexp_extract(t, '{_CLOCK}', 1), 2, '0') || ':' || regexp_extract(t, '{_CLOCK}', 2) || ':' || coalesce(nullif(regexp_extract(t, '{_CLOCK}', 3), ''), '00') END AS clock FROM x",
)


def with_flags(ledger: DataFrame) -> DataFrame:
    """Adds analytics_flags, the tokens of the row detectors that mark a row, in a fixed order."""
    bursts = velocity(ledger).filter("is_velocity_flag").select("leg_id", F.lit("VELOCITY").alias("burst"))
    far = iqr_outliers(ledger).select("leg_id", F.lit("OUTLIER").alias("far")).distinct()
    return ledger.join(bursts, "leg_id", "left").join(far, "leg_id", "left").withColumn("analytics_flags", F.array_compact(F.array("burst", "far"))).drop("burst", "far")


register(
    "im_append_flag",
    lambda s, d: with_flags(legs(s, d)).filter(F.size("analytics_flags") > 0).select("leg_id", F.array_join("analytics_flags", " | ").alias("analytics_flags")),
    _SHARES
    + """, sides AS (SELECT leg_id, account_id, 'debit' AS side, debit AS amount FROM legs UNION ALL SELECT leg_id, account_id, 'credit', credit FROM legs),
q AS (SELECT account_id, side, quantile_cont(CAST(amount AS DOUBLE), 0.25) FILTER (amount > 0) AS q1, quantile_cont(CAST(amount AS DOUBLE), 0.75) FILTER (amount > 0) AS q3 FROM sides GROUP BY 1, 2 HAVING count(*) >= 10 AND count(*) FILTER (amount > 0) >= 4),
tokens AS (SELECT leg_id, 'VELOCITY' AS t FROM bursts WHERE hit = 1 UNION SELECT leg_id, 'OUTLIER' FROM sides JOIN q USING (account_id, side) WHERE q3 <> q1 AND CAST(amount AS DOUBLE) > q3 + 3.0 * (q3 - q1))
SELECT leg_id, string_agg(t, ' | ' ORDER BY t DESC) AS analytics_flags FROM tokens GROUP BY 1""",
)
