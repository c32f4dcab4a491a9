"""Beneficiaries, account profiles, segments, suppression and risk scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import register
from ..schema import BENEFICIARY, day
from ..sources.ledger_view import LEGS_SQL, legs
from .windows import iqr_outliers, velocity


def beneficiaries(ledger: DataFrame) -> DataFrame:
    """What each account sends to each party, against the account's own debits (population spread, 1 for a single debit)."""
    debits = ledger.filter("debit > 0 and cp <> ''").withColumn("x", F.col("debit").cast("double"))
    own = debits.groupBy("account_id").agg(F.sum("debit").alias("all_sent"), F.avg("x").alias("mean"), F.when(F.count("*") > 1, F.stddev_pop("x")).otherwise(1.0).alias("std"), F.max("x").alias("top"))
    per = debits.groupBy("account_id", "cp").agg(F.sum("debit").alias("sent"), F.count("*").alias("txn_count"), F.max("x").alias("max_single"), F.min("ts").alias("first"), F.max("ts").alias("last")).join(own, "account_id")
    z = F.when(F.col("std") > 0, (F.col("max_single") - F.col("mean")) / F.col("std")).otherwise(0.0)
    new = (F.col("txn_count") == 1) & (F.col("max_single") / F.col("top") >= BENEFICIARY["new_ratio"])
    return per.select("account_id", F.col("cp").alias("counterparty_name"), F.col("sent").cast("double").alias("total_sent"), F.round(F.col("sent").cast("double") / F.col("all_sent").cast("double"), 4).alias("sent_share_of_account"), "txn_count", F.col("max_single").alias("max_single_txn"), day(F.col("first")).alias("first_date"), day(F.col("last")).alias("last_date"), F.when(F.abs(z) < 0.0005, 0.0).otherwise(F.round(z, 3)).alias("amount_zscore"), new.alias("is_new_high_value_bene"), (z >= BENEFICIARY["zscore"]).alias("is_high_value_bene"))


_BENE = f"""WITH {LEGS_SQL},
deb AS (SELECT *, CAST(debit AS DOUBLE) AS x FROM legs WHERE debit > 0),
own AS (SELECT account_id, sum(debit) AS all_sent, avg(x) AS mean, CASE WHEN count(*) > 1 THEN stddev_pop(x) ELSE 1.0 END AS std, max(x) AS top FROM deb GROUP BY 1),
per AS (SELECT account_id, cp, sum(debit) AS sent, count(*) AS txn_count, max(x) AS max_single, min(ts) AS first, max(ts) AS last FROM deb GROUP BY 1, 2),
bene AS (SELECT account_id, cp AS counterparty_name, CAST(sent AS DOUBLE) AS total_sent, round(CAST(sent AS DOUBLE) / CAST(all_sent AS DOUBLE), 4) AS sent_share_of_account, txn_count, max_single AS max_single_txn, strftime(first, '%Y-%m-%d') AS first_date,
  strftime(last, '%Y-%m-%d') AS last_date, CASE WHEN std > 0 AND abs((max_single - mean) / std) >= 0.0005 THEN round((max_single - mean) / std, 3) ELSE 0.0 END AS amount_zscore, txn_count = 1 AND max_single / top >= 0.5 AS is_new_high_value_bene, std > 0 AND (max_single - mean) / std >= 2.5 AS is_high_value_bene FROM per JOIN own USING (account_id))"""
register("ag_beneficiary", lambda s, d: beneficiaries(legs(s, d)), f"{_BENE} SELECT * FROM bene")


def profiles(ledger: DataFrame) -> DataFrame:
    """Frozen statistics of each account."""
    x = (F.col("debit") + F.col("credit")).cast("double")
    hour = F.hour("ts")
    days = F.greatest(F.lit(1), F.floor((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 86400).cast("int"))
    return ledger.withColumn("x", x).groupBy("account_id").agg(F.round(F.avg("x"), 9).alias("avg_amount"), F.round(F.coalesce(F.stddev_samp("x"), F.lit(1.0)), 4).alias("std_amount"), F.percentile("x", F.lit(0.5)).alias("median_amount"), F.max("x").alias("max_amount"), F.count("*").alias("txn_count"), F.round(F.count_if(F.col("credit") > 0) / F.count("*"), 6).alias("credit_ratio"), F.round(F.count_if((hour >= 22) | (hour <= 5)) / F.count("*"), 6).alias("night_ratio"), F.count_distinct("cp").alias("n_counterparties"), days.cast("long").alias("active_days"))


_PROFILE = f"""WITH {LEGS_SQL}, x AS (SELECT *, CAST(debit + credit AS DOUBLE) AS x FROM legs),
profile AS (SELECT account_id, round(avg(x), 9) AS avg_amount, round(coalesce(stddev_samp(x), 1.0), 4) AS std_amount, quantile_cont(x, 0.5) AS median_amount, max(x) AS max_amount, count(*) AS txn_count, round(count(*) FILTER (credit > 0) / count(*), 6) AS credit_ratio,
  round(count(*) FILTER (hour(ts) >= 22 OR hour(ts) <= 5) / count(*), 6) AS night_ratio, count(DISTINCT cp) AS n_counterparties, CAST(greatest(1, floor((epoch(max(ts)) - epoch(min(ts))) / 86400)) AS BIGINT) AS active_days FROM x GROUP BY 1)"""
register("ag_account_profile", lambda s, d: profiles(legs(s, d)), f"{_PROFILE} SELECT * FROM profile")
register("ag_global_stats", lambda s, d: legs(s, d).select((F.col("debit") + F.col("credit")).cast("double").alias("x")).agg(F.round(F.avg("x"), 9).alias("mean"), F.round(F.stddev_samp("x"), 4).alias("std"), F.percentile("x", F.lit(0.5)).alias("median")), f"WITH {LEGS_SQL}, x AS (SELECT CAST(debit + credit AS DOUBLE) AS x FROM legs) SELECT round(avg(x), 9) AS mean, round(stddev_samp(x), 4) AS std, quantile_cont(x, 0.5) AS median FROM x")
register("ag_hour_stats", lambda s, d: legs(s, d).groupBy(F.hour("ts").alias("hour")).agg(F.round(F.avg((F.col("debit") + F.col("credit")).cast("double")), 9).alias("mean"), F.count("*").alias("n")), f"WITH {LEGS_SQL} SELECT CAST(hour(ts) AS INT) AS hour, round(avg(CAST(debit + credit AS DOUBLE)), 9) AS mean, count(*) AS n FROM legs GROUP BY 1")


def segments(ledger: DataFrame, volume: float = 500_000.0, txns: float = 60.0, average: float = 5_000.0) -> DataFrame:
    """business where volume and count over thirty days and the mean amount are all high, else retail."""
    days = F.greatest(F.lit(1), F.floor((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 86400).cast("int"))
    per = ledger.groupBy("account_id").agg(F.sum(F.col("debit") + F.col("credit")).cast("double").alias("total"), F.count("*").alias("n"), days.alias("days"))
    hit = (F.col("total") / (F.col("days") / 30) >= volume) & (F.col("n") / (F.col("days") / 30) >= txns) & (F.col("total") / F.col("n") >= average)
    return per.select("account_id", F.when(hit, "business").otherwise("retail").alias("entity_segment"))


register(
    "ag_segment",
    lambda s, d: segments(legs(s, d), txns=30.0),
    f"WITH {LEGS_SQL}, p AS (SELECT account_id, CAST(sum(debit + credit) AS DOUBLE) AS total, count(*) AS n, greatest(1, floor((epoch(max(ts)) - epoch(min(ts))) / 86400)) AS days FROM legs GROUP BY 1) SELECT account_id, CASE WHEN total / (days / 30) >= 500000 AND n / (days / 30) >= 30 AND total / n >= 5000 THEN 'business' ELSE 'retail' END AS entity_segment FROM p",
)


def suppress(ledger: DataFrame, flagged: Column, least: int = 5) -> DataFrame:
    """Silences flagged rows that a frequent party, a salary, or a business account's usual amounts explain."""
    from pyspark.sql import Window

    pair = F.count("*").over(Window.partitionBy("account_id", "cp"))
    rows = ledger.withColumns({"amount": (F.col("debit") + F.col("credit")).cast("double"), "pair_n": pair, "flagged": flagged}).filter("flagged")
    median = profiles(ledger).select("account_id", "median_amount")
    rows = rows.join(median, "account_id").join(segments(ledger, txns=30.0), "account_id")
    reasons = F.array_compact(F.array(F.when(F.col("pair_n") > least, "frequent_counterparty"), F.when(F.upper("narration").rlike("SALARY|SAL|PAYROLL"), "salary_pattern"), F.when((F.col("entity_segment") == "business") & (F.col("amount") <= F.col("median_amount") * 2.5), "business_normal_range")))
    return rows.select("leg_id", "account_id", F.array_join(reasons, ";").alias("suppression_reason"), (F.size(reasons) == 0).alias("final_flag"))


def detector_flags(ledger: DataFrame) -> DataFrame:
    """(leg_id) of the rows that the row detectors mark: bursts and amounts far above the account's own."""
    return velocity(ledger).filter("is_velocity_flag").select("leg_id").union(iqr_outliers(ledger).select("leg_id")).distinct()


def suppressed(ledger: DataFrame) -> DataFrame:
    """suppress() over every row that a detector marks."""
    marked = ledger.join(detector_flags(ledger).withColumn("marked", F.lit(True)), "leg_id", "left")
    return suppress(marked, F.coalesce("marked", F.lit(False)))


_SUPPRESS = f"""{_PROFILE}, seg AS (SELECT account_id, CASE WHEN sum(x) / (active / 30) >= 500000 AND count(*) / (active / 30) >= 30 AND sum(x) / count(*) >= 5000 THEN 'business' ELSE 'retail' END AS s FROM (SELECT x.*, active_days AS active FROM x JOIN profile USING (account_id)) GROUP BY account_id, active),
anchors AS (SELECT *, count(*) OVER (PARTITION BY account_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 30 MINUTE FOLLOWING) AS n FROM legs WHERE time <> '00:00:00'),
bursts AS (SELECT leg_id, max(CASE WHEN n >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) AS hit FROM anchors),
sides AS (SELECT leg_id, account_id, 'debit' AS side, debit AS amount FROM legs UNION ALL SELECT leg_id, account_id, 'credit', credit FROM legs),
q AS (SELECT account_id, side, quantile_cont(CAST(amount AS DOUBLE), 0.25) FILTER (amount > 0) AS q1, quantile_cont(CAST(amount AS DOUBLE), 0.75) FILTER (amount > 0) AS q3 FROM sides GROUP BY 1, 2 HAVING count(*) >= 10 AND count(*) FILTER (amount > 0) >= 4),
marked AS MATERIALIZED (SELECT leg_id FROM bursts WHERE hit = 1 UNION SELECT leg_id FROM sides JOIN q USING (account_id, side) WHERE q3 <> q1 AND CAST(amount AS DOUBLE) > q3 + 3.0 * (q3 - q1)),
r AS (SELECT leg_id, account_id, list_filter([CASE WHEN count(*) OVER (PARTITION BY account_id, cp) > 5 THEN 'frequent_counterparty' END, CASE WHEN regexp_matches(upper(narration), 'SALARY|SAL|PAYROLL') THEN 'salary_pattern' END, CASE WHEN s = 'business' AND x <= median_amount * 2.5 THEN 'business_normal_range' END], lambda f: f IS NOT NULL) AS reasons
  FROM x JOIN profile USING (account_id) JOIN seg USING (account_id)),
rated AS (SELECT leg_id, account_id, array_to_string(reasons, ';') AS suppression_reason, len(reasons) = 0 AS final_flag FROM r WHERE leg_id IN (SELECT leg_id FROM marked))"""
register("ml_suppress", lambda s, d: suppressed(legs(s, d)), f"{_SUPPRESS} SELECT * FROM rated")
register(
    "ag_suppression_reasons",
    lambda s, d: suppressed(legs(s, d)).filter("suppression_reason <> ''").select(F.explode(F.split("suppression_reason", ";")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")),
    f"{_SUPPRESS} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(suppression_reason, ';')) AS reason FROM rated WHERE suppression_reason <> '') GROUP BY 1",
)


def count_score(n: Column) -> Column:
    return F.least(F.log1p(F.coalesce(n, F.lit(0)).cast("double")) / F.log(F.lit(6.0)), F.lit(1.0))


def risk_tier(score: Column, high_seen: Column) -> Column:
    """CRITICAL from 75, HIGH from 50, MEDIUM from 25; where no account of a run is HIGH, 45 and 30 count as well."""
    tier = F.when(score >= 75, "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW")
    return F.when(high_seen, tier).otherwise(F.when(score >= 45, "CRITICAL").when(score >= 30, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW"))


def community_risk(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """(community, n_accounts, avg_risk, max_risk) over the scored accounts of each community; others don't count."""
    members = labels.select(F.col("id").alias("account_id"), "community").join(scores.select("account_id", "risk_score"), "account_id")
    return members.groupBy("community").agg(F.count("*").alias("n_accounts"), F.round(F.avg("risk_score"), 2).alias("avg_risk"), F.round(F.max("risk_score"), 2).alias("max_risk"))
