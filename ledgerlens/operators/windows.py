"""Detectors on each account's ordered rows: fans, structuring, odd hours, bursts, balances, gaps and sums.

All windows are partitioned by account_id, so those used together share one exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..schema import BALANCE, FAN, MONEY, ODD, OUTLIER, SMURF, VELOCITY, day, epoch, joined
from ..sources.ledger_view import BALANCED_SQL, LEGS_SQL, balanced, legs



def by_account():
    return Window.partitionBy("account_id")


def in_order():
    return by_account().orderBy("ts", "leg_id")


def floors(rows: DataFrame, amount: str, quantile: float) -> DataFrame:
    """(account_id, floor): the interpolated quantile of each account's positive amounts."""
    return rows.filter(F.col(amount) > 0).groupBy("account_id").agg(F.percentile(F.col(amount).cast("double"), F.lit(quantile)).alias("floor"))


def ahead(seconds: int):
    return by_account().orderBy("t").rangeBetween(0, seconds)


def fan(ledger: DataFrame, direction: str) -> DataFrame:
    """The first window of each account in which large amounts come from, or go to, enough parties.

    Columns: account_id, parties (array), n_parties, total, window_start, window_end, txn_count, floor, severity.
    """
    rule, amount = FAN[direction], "credit" if direction == "in" else "debit"
    rows = ledger.filter((F.col(amount) > 0) & (F.col("cp") != "")).withColumn("t", epoch(F.col("ts")))
    large = rows.join(floors(rows, amount, rule["quantile"]), "account_id").filter(F.col(amount).cast("double") >= F.col("floor"))
    frame = ahead(rule["hours"] * 3600)
    seen = large.select("account_id", "ts", "leg_id", "floor", F.collect_set("cp").over(frame).alias("parties"), F.sum(amount).over(frame).alias("total"), F.max("ts").over(frame).alias("end"), F.count("*").over(frame).alias("txn_count"))
    first = seen.filter(F.size("parties") >= rule["parties"]).withColumn("k", F.row_number().over(in_order())).filter("k = 1")
    n = F.size("parties")
    return first.select("account_id", F.slice(F.array_sort("parties"), 1, 50).alias("parties"), n.cast("long").alias("n_parties"), F.col("total").cast("double").alias("total"), F.col("ts").alias("window_start"), F.col("end").alias("window_end"), "txn_count", "floor", F.when(n >= 8, "CRITICAL").otherwise("HIGH").alias("severity"))


def _fan_query(direction: str, names: tuple[str, str, str, str]):
    def query(spark, sf_dir):
        account, count, parties, total = names
        return fan(legs(spark, sf_dir), direction).select(F.col("account_id").alias(account), F.col("n_parties").alias(count), joined(F.col("parties")).alias(parties), F.col("total").alias(total), day(F.col("window_start")).alias("window_start"), day(F.col("window_end")).alias("window_end"), "txn_count", F.round("floor", 6).alias("amount_floor_used"), "severity")

    return query


def _fan_sql(amount: str, hours: int, names: tuple[str, str, str, str]) -> str:
    account, count, parties, total = names
    return f"""WITH {LEGS_SQL},
floors AS (SELECT account_id, quantile_cont(CAST({amount} AS DOUBLE), 0.6) AS floor FROM legs WHERE {amount} > 0 GROUP BY 1),
large AS (SELECT legs.*, floor FROM legs JOIN floors USING (account_id) WHERE {amount} > 0 AND CAST({amount} AS DOUBLE) >= floor),
seen AS (SELECT a.account_id, a.leg_id, a.ts, a.floor, count(DISTINCT b.cp) AS n, list(DISTINCT b.cp) AS parties, sum(b.{amount}) AS total, max(b.ts) AS ends, count(*) AS txns
  FROM large a JOIN large b ON a.account_id = b.account_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL {hours} HOUR GROUP BY ALL HAVING count(DISTINCT b.cp) >= 4),
first AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ts, leg_id) AS k FROM seen)
SELECT account_id AS {account}, n AS {count}, array_to_string(list_sort(parties)[1:50], ',') AS {parties}, CAST(total AS DOUBLE) AS {total}, strftime(ts, '%Y-%m-%d') AS window_start,
  strftime(ends, '%Y-%m-%d') AS window_end, txns AS txn_count, round(floor, 6) AS amount_floor_used, CASE WHEN n >= 8 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM first WHERE k = 1"""


_IN, _OUT = ("collector", "sender_count", "senders", "total_inflow"), ("distributor", "receiver_count", "receivers", "total_outflow")
register("wn_fan_in", _fan_query("in", _IN), _fan_sql("credit", 72, _IN))
register("wn_fan_out", _fan_query("out", _OUT), _fan_sql("debit", 48, _OUT))


def smurfing(ledger: DataFrame) -> DataFrame:
    """The first fortnight of each account with enough debits just below its upper quartile to enough parties."""
    rows = ledger.filter((F.col("debit") > 0) & (F.col("cp") != "")).withColumn("t", epoch(F.col("ts")))
    stats = rows.groupBy("account_id").agg(F.percentile(F.col("debit").cast("double"), F.lit(SMURF["quantile"])).alias("high"), F.count("*").alias("n")).filter(F.col("n") >= SMURF["account_txns"]).withColumn("low", F.col("high") * SMURF["lower"])
    band = rows.join(stats, "account_id").filter(F.col("debit").cast("double").between(F.col("low"), F.col("high")))
    frame = ahead(SMURF["days"] * 86400)
    seen = band.select("account_id", "ts", "leg_id", "low", "high", F.collect_set("cp").over(frame).alias("to"), F.sum("debit").over(frame).alias("total"), F.max("ts").over(frame).alias("end"), F.count("*").over(frame).alias("txn_count"))
    hits = seen.filter((F.col("txn_count") >= SMURF["txns"]) & (F.size("to") >= SMURF["destinations"]))
    first = hits.withColumn("k", F.row_number().over(in_order())).filter("k = 1")
    return first.select(F.col("account_id").alias("account"), "txn_count", F.col("total").cast("double").alias("total_amount"), F.round("low", 6).alias("amount_band_low"), F.round("high", 6).alias("amount_band_high"), F.size("to").cast("long").alias("unique_destinations"), F.slice(F.array_sort("to"), 1, 25).alias("destinations"), F.col("ts").alias("window_start"), F.col("end").alias("window_end"), F.when(F.col("txn_count") >= 6, "HIGH").otherwise("MEDIUM").alias("severity"))


register(
    "wn_smurf",
    lambda s, d: smurfing(legs(s, d)).withColumns({"destinations": joined(F.col("destinations")), "window_start": day(F.col("window_start")), "window_end": day(F.col("window_end"))}),
    f"""WITH {LEGS_SQL},
stats AS (SELECT account_id, quantile_cont(CAST(debit AS DOUBLE), 0.75) AS high, quantile_cont(CAST(debit AS DOUBLE), 0.75) * 0.8 AS low FROM legs WHERE debit > 0 GROUP BY 1 HAVING count(*) >= 8),
band AS (SELECT legs.*, low, high FROM legs JOIN stats USING (account_id) WHERE debit > 0 AND CAST(debit AS DOUBLE) BETWEEN low AND high),
seen AS (SELECT a.account_id, a.leg_id, a.ts, a.low, a.high, count(DISTINCT b.cp) AS n, list(DISTINCT b.cp) AS dests, sum(b.debit) AS total, max(b.ts) AS ends, count(*) AS txns
  FROM band a JOIN band b ON a.account_id = b.account_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 14 DAY GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT b.cp) >= 2),
first AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ts, leg_id) AS k FROM seen)
SELECT account_id AS account, txns AS txn_count, CAST(total AS DOUBLE) AS total_amount, round(low, 6) AS amount_band_low, round(high, 6) AS amount_band_high, n AS unique_destinations,
  array_to_string(list_sort(dests)[1:25], ',') AS destinations, strftime(ts, '%Y-%m-%d') AS window_start, strftime(ends, '%Y-%m-%d') AS window_end, CASE WHEN txns >= 6 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM first WHERE k = 1""",
)


def odd_hours(ledger: DataFrame) -> DataFrame:
    """Accounts with a large share of rows at night; a time of exactly midnight is unknown and doesn't count."""
    hour = F.coalesce(F.split("time", ":")[0].try_cast("int"), F.lit(12))
    timed = F.col("time") != "00:00:00"
    odd = timed & (hour >= ODD["start"]) & (hour < ODD["end"])
    per = ledger.groupBy("account_id").agg(
        F.count("*").alias("n"),
        F.count_if(timed).alias("timed_txns"),
        F.count_if(odd).alias("odd_hour_txns"),
        F.sum(F.when(odd, F.col("debit"))).cast("double").alias("total_debit"),
        F.sum(F.when(odd, F.col("credit"))).cast("double").alias("total_credit"),
        F.collect_set(F.when(odd, hour)).alias("hours"),
        F.min(F.when(odd, F.col("date"))).alias("first_date"),
        F.max(F.when(odd, F.col("date"))).alias("last_date"),
    )
    ratio = F.col("odd_hour_txns") / F.col("timed_txns")
    hit = (F.col("timed_txns") >= ODD["txns"]) & (F.col("timed_txns") / F.col("n") >= ODD["timed_ratio"]) & (F.col("odd_hour_txns") >= ODD["txns"])
    return per.filter(hit).withColumn("ratio", ratio).filter(F.col("ratio") >= ODD["odd_ratio"]).select(F.col("account_id").alias("account"), "odd_hour_txns", "timed_txns", F.round("ratio", 4).alias("odd_hour_ratio"), "total_debit", "total_credit", F.array_sort("hours").alias("hours_active"), "first_date", "last_date", F.when(F.col("ratio") >= 0.5, "HIGH").otherwise("MEDIUM").alias("severity"))


register(
    "ag_odd_hours",
    lambda s, d: odd_hours(legs(s, d)).withColumn("hours_active", F.array_join(F.col("hours_active").cast("array<string>"), ",")),
    f"""WITH {LEGS_SQL},
x AS (SELECT *, time <> '00:00:00' AS timed, CAST(split_part(time, ':', 1) AS INT) AS hour FROM legs),
per AS (SELECT account_id, count(*) AS n, count(*) FILTER (timed) AS timed_txns, count(*) FILTER (timed AND hour < 5) AS odd_hour_txns, sum(debit) FILTER (timed AND hour < 5) AS td, sum(credit) FILTER (timed AND hour < 5) AS tc,
  list_sort(list(DISTINCT hour) FILTER (timed AND hour < 5)) AS hours, min(date) FILTER (timed AND hour < 5) AS first_date, max(date) FILTER (timed AND hour < 5) AS last_date FROM x GROUP BY 1)
SELECT account_id AS account, odd_hour_txns, timed_txns, round(odd_hour_txns / timed_txns, 4) AS odd_hour_ratio, CAST(td AS DOUBLE) AS total_debit, CAST(tc AS DOUBLE) AS total_credit, array_to_string(hours, ',') AS hours_active,
  first_date, last_date, CASE WHEN odd_hour_txns / timed_txns >= 0.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM per WHERE timed_txns >= 3 AND timed_txns / n >= 0.20 AND odd_hour_txns >= 3 AND odd_hour_txns / timed_txns >= 0.25""",
)


def velocity(ledger: DataFrame) -> DataFrame:
    """Marks every row of a burst: enough timed rows within half an hour of one of them."""
    timed = ledger.filter("time <> '00:00:00'").withColumn("t", epoch(F.col("ts")))
    span = VELOCITY["minutes"] * 60
    anchored = timed.withColumn("starts", (F.count("*").over(ahead(span)) >= VELOCITY["txns"]).cast("int"))
    return anchored.withColumn("is_velocity_flag", F.max("starts").over(by_account().orderBy("t").rangeBetween(-span, 0)) == 1).drop("starts", "t")


register(
    "wn_velocity",
    lambda s, d: velocity(legs(s, d)).filter("is_velocity_flag").select("leg_id", "account_id", "date", "time"),
    f"""WITH {LEGS_SQL},
timed AS (SELECT * FROM legs WHERE time <> '00:00:00'),
anchors AS (SELECT *, count(*) OVER (PARTITION BY account_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 30 MINUTE FOLLOWING) AS n FROM timed)
SELECT leg_id, account_id, date, time FROM (SELECT *, max(CASE WHEN n >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) AS hit FROM anchors) WHERE hit = 1""",
)


def balance_breaks(ledger: DataFrame) -> DataFrame:
    """Differences between a balance and what the row before leads to, by size; accounts whose balance stands still are left out."""
    before = F.lag("balance").over(in_order())
    moved = F.col("credit") - F.col("debit")
    pairs = ledger.withColumn("before", before).filter("before is not null and balance is not null").withColumn("diff", F.abs(F.col("before") + F.col("credit") - F.col("debit") - F.col("balance")))
    moves = F.count_if(moved != 0).over(by_account())
    stuck = F.count_if((moved != 0) & (F.abs(F.col("balance") - F.col("before")) <= BALANCE["tolerance"])).over(by_account())
    flat = (moves >= BALANCE["flat_txns"]) & (stuck / moves >= BALANCE["flat_ratio"])
    kind = F.when(F.col("diff") <= BALANCE["tolerance"], "OK").when(F.col("diff") <= BALANCE["minor"], "MINOR").otherwise("MAJOR")
    return pairs.withColumn("flat", flat).filter(~F.coalesce("flat", F.lit(False))).withColumn("kind", kind).drop("flat")


register(
    "wn_balance",
    lambda s, d: balance_breaks(balanced(legs(s, d))).filter("kind <> 'OK'").select("leg_id", "account_id", F.col("diff").cast("double").alias("breach_amount"), "kind"),
    f"""WITH {BALANCED_SQL},
pairs AS (SELECT *, lag(balance) OVER (PARTITION BY account_id ORDER BY ts, leg_id) AS prev FROM ledger),
valid AS (SELECT *, abs(prev + credit - debit - balance) AS diff FROM pairs WHERE prev IS NOT NULL AND balance IS NOT NULL),
flats AS (SELECT account_id FROM valid GROUP BY 1 HAVING count(*) FILTER (credit <> debit) >= 5 AND count(*) FILTER (credit <> debit AND abs(balance - prev) <= 0.01) / count(*) FILTER (credit <> debit) >= 0.9)
SELECT leg_id, account_id, CAST(diff AS DOUBLE) AS breach_amount, CASE WHEN diff <= 5 THEN 'MINOR' ELSE 'MAJOR' END AS kind FROM valid WHERE diff > 0.01 AND account_id NOT IN (SELECT account_id FROM flats)""",
)
register(
    "ag_suspects",
    lambda s, d: (
        balance_breaks(balanced(legs(s, d))).groupBy("account_id").agg(F.count_if(F.col("kind") == "MAJOR").alias("breach_rows"), F.count("*").alias("total_rows"), F.round(F.max(F.when(F.col("kind") != "OK", F.col("diff"))), 2).cast("double").alias("max_breach_amount"))
        .withColumn("ratio", F.col("breach_rows") / F.col("total_rows")).filter(F.col("ratio") > BALANCE["account_ratio"])
        .select("account_id", F.round("ratio", 3).alias("breach_ratio"), "breach_rows", "total_rows", "max_breach_amount", F.when(F.col("ratio") > 0.5, "HIGH").otherwise("MEDIUM").alias("severity"))
    ),
    f"""WITH {BALANCED_SQL},
pairs AS (SELECT *, lag(balance) OVER (PARTITION BY account_id ORDER BY ts, leg_id) AS prev FROM ledger),
valid AS (SELECT *, abs(prev + credit - debit - balance) AS diff FROM pairs WHERE prev IS NOT NULL AND balance IS NOT NULL),
flats AS (SELECT account_id FROM valid GROUP BY 1 HAVING count(*) FILTER (credit <> debit) >= 5 AND count(*) FILTER (credit <> debit AND abs(balance - prev) <= 0.01) / count(*) FILTER (credit <> debit) >= 0.9),
per AS (SELECT account_id, count(*) FILTER (diff > 5) AS breach_rows, count(*) AS total_rows, max(CASE WHEN diff > 0.01 THEN diff END) AS m FROM valid WHERE account_id NOT IN (SELECT account_id FROM flats) GROUP BY 1)
SELECT account_id, round(breach_rows / total_rows, 3) AS breach_ratio, breach_rows, total_rows, CAST(m AS DOUBLE) AS max_breach_amount, CASE WHEN breach_rows / total_rows > 0.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM per WHERE breach_rows / total_rows > 0.05""",
)


def iqr_outliers(ledger: DataFrame) -> DataFrame:
    """Amounts beyond the third quartile and three quartile ranges of their account and side."""
    sides = ledger.select("leg_id", "account_id", F.explode(F.map_from_arrays(F.array(F.lit("debit"), F.lit("credit")), F.array("debit", "credit"))).alias("side", "amount"))
    of_account = sides.groupBy("account_id", "side").agg(F.count("*").alias("n"), F.count_if(F.col("amount") > 0).alias("nonzero"), F.percentile(F.when(F.col("amount") > 0, F.col("amount").cast("double")), F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    usable = of_account.filter((F.col("n") >= OUTLIER["txns"]) & (F.col("nonzero") >= OUTLIER["nonzero"])).select("account_id", "side", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")).filter("q3 <> q1")
    fence = F.col("q3") + OUTLIER["times_iqr"] * (F.col("q3") - F.col("q1"))
    return sides.join(usable, ["account_id", "side"]).filter(F.col("amount").cast("double") > fence).select("leg_id", "account_id", "side", F.col("amount").cast("double").alias("amount"), F.round(fence, 6).alias("fence"))


register(
    "ag_iqr_outlier",
    lambda s, d: iqr_outliers(legs(s, d).withColumn("debit", F.when(F.col("rid") % 101 == 0, F.col("debit") * 10).otherwise(F.col("debit")).cast(MONEY))),
    f"""WITH {LEGS_SQL},
sides AS (SELECT leg_id, account_id, 'debit' AS side, CAST(CASE WHEN rid % 101 = 0 THEN debit * 10 ELSE debit END AS decimal(18,2)) AS amount FROM legs UNION ALL SELECT leg_id, account_id, 'credit', credit FROM legs),
q AS (SELECT account_id, side, quantile_cont(CAST(amount AS DOUBLE), 0.25) FILTER (amount > 0) AS q1, quantile_cont(CAST(amount AS DOUBLE), 0.75) FILTER (amount > 0) AS q3 FROM sides GROUP BY 1, 2 HAVING count(*) >= 10 AND count(*) FILTER (amount > 0) >= 4)
SELECT leg_id, account_id, side, CAST(amount AS DOUBLE) AS amount, round(q3 + 3.0 * (q3 - q1), 6) AS fence FROM sides JOIN q USING (account_id, side) WHERE q3 <> q1 AND CAST(amount AS DOUBLE) > q3 + 3.0 * (q3 - q1)""",
)


def gaps(ledger: DataFrame) -> DataFrame:
    """Minutes since the account's row before (99999 for the first), their logarithm, and debits soon after a credit."""
    t = epoch(F.col("ts"))
    minutes = F.coalesce((t - F.lag(t).over(in_order())) / 60, F.lit(99999.0))
    after_credit = F.lag("credit").over(in_order()) > 0
    return ledger.select("leg_id", "account_id", "debit", "credit", "ts", minutes.alias("minutes"), after_credit.alias("after_credit")).withColumn("gap_log", F.log1p("minutes")).withColumn("rapid", (F.col("debit") > 0) & F.coalesce("after_credit", F.lit(False)) & (F.col("minutes") <= 120))


register(
    "wn_gap",
    lambda s, d: gaps(legs(s, d)).select("leg_id", "minutes", F.round("gap_log", 6).alias("gap_log")),
    f"WITH {LEGS_SQL}, g AS (SELECT leg_id, coalesce((epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY account_id ORDER BY ts, leg_id)) / 60, 99999.0) AS minutes FROM legs) SELECT leg_id, CAST(minutes AS DOUBLE) AS minutes, round(ln(1 + CAST(minutes AS DOUBLE)), 6) AS gap_log FROM g",
)
register(
    "wn_rapid",
    lambda s, d: gaps(legs(s, d)).filter("rapid").select("leg_id", "account_id"),
    f"WITH {LEGS_SQL}, g AS (SELECT *, lag(ts) OVER w AS pt, lag(credit) OVER w AS pc FROM legs WINDOW w AS (PARTITION BY account_id ORDER BY ts, leg_id)) SELECT leg_id, account_id FROM g WHERE debit > 0 AND pc > 0 AND ts - pt <= INTERVAL 120 MINUTE",
)


def with_velocity(ledger: DataFrame, days: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Adds sums and counts of the account's earlier rows within some days (and the columns t, amount, own, own_n).

    A range frame holds the rows of the current moment too; those from the current row on are taken off again.
    """
    amount = F.col("debit") + F.col("credit")
    rows = ledger.withColumn("t", epoch(F.col("ts"))).withColumn("amount", amount)
    rest = Window.partitionBy("account_id", "t").orderBy("leg_id").rowsBetween(0, Window.unboundedFollowing)
    out = rows.withColumns({"own": F.sum("amount").over(rest), "own_n": F.count("*").over(rest)})
    for n in days:
        frame = by_account().orderBy("t").rangeBetween(-n * 86400, 0)
        out = out.withColumns({f"sum_{n}d": (F.sum("amount").over(frame) - F.col("own")).cast("double"), f"count_{n}d": F.count("*").over(frame) - F.col("own_n")})
    return out


def velocity_sums(ledger: DataFrame, days: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    return with_velocity(ledger, days).select("leg_id", "account_id", *(f"{k}_{n}d" for n in days for k in ("sum", "count")))


register(
    "wn_vel_sum",
    lambda s, d: velocity_sums(legs(s, d)),
    f"WITH {LEGS_SQL} SELECT a.leg_id, a.account_id, "
    + ", ".join(f"CAST(coalesce(sum(b.debit + b.credit) FILTER (b.ts >= a.ts - INTERVAL {n} DAY), 0) AS DOUBLE) AS sum_{n}d, count(b.leg_id) FILTER (b.ts >= a.ts - INTERVAL {n} DAY) AS count_{n}d" for n in (1, 7, 30))
    + " FROM legs a LEFT JOIN legs b ON a.account_id = b.account_id AND b.ts >= a.ts - INTERVAL 30 DAY AND (b.ts < a.ts OR (b.ts = a.ts AND b.leg_id < a.leg_id)) GROUP BY 1, 2",
)
register(
    "wn_zscore",
    lambda s, d: (
        legs(s, d).withColumn("amount", (F.col("debit") + F.col("credit")).cast("double"))
        .withColumn("z", (F.col("amount") - F.avg("amount").over(by_account())) / (F.coalesce(F.nullif(F.stddev_samp("amount").over(by_account()), F.lit("NaN").cast("double")), F.lit(1.0)) + 1e-9))
        .withColumn("z", F.round(F.least(F.greatest("z", F.lit(-10.0)), F.lit(10.0)), 4))
        .select("leg_id", "account_id", F.when(F.col("z") == 0, 0.0).otherwise(F.col("z")).alias("amount_zscore"))
    ),
    f"WITH {LEGS_SQL}, x AS (SELECT leg_id, account_id, CAST(debit + credit AS DOUBLE) AS amount FROM legs) SELECT leg_id, account_id, CASE WHEN z = 0 THEN 0.0 ELSE z END AS amount_zscore FROM (SELECT leg_id, account_id, round(least(greatest((amount - avg(amount) OVER w) / (coalesce(stddev_samp(amount) OVER w, 1.0) + 1e-9), -10.0), 10.0), 4) AS z FROM x WINDOW w AS (PARTITION BY account_id))",
)
register(
    "wn_share",
    lambda s, d: (
        legs(s, d).filter("debit > 0").groupBy("account_id", "cp").agg(F.sum("debit").alias("sent")).withColumn("of_all", F.sum("sent").over(by_account()))
        .select("account_id", F.col("cp").alias("counterparty_name"), F.col("sent").cast("double").alias("total_sent"), F.round(F.col("sent").cast("double") / F.col("of_all").cast("double"), 4).alias("sent_share"))
    ),
    f"WITH {LEGS_SQL}, s AS (SELECT account_id, cp, sum(debit) AS sent FROM legs WHERE debit > 0 GROUP BY 1, 2) SELECT account_id, cp AS counterparty_name, CAST(sent AS DOUBLE) AS total_sent, round(CAST(sent AS DOUBLE) / CAST(sum(sent) OVER (PARTITION BY account_id) AS DOUBLE), 4) AS sent_share FROM s",
)
register(
    "wn_rank",
    lambda s, d: legs(s, d).filter("debit > 0").withColumn("place", F.row_number().over(by_account().orderBy(F.desc("debit"), "leg_id"))).filter("place <= 3").select("account_id", "leg_id", "place"),
    f"WITH {LEGS_SQL} SELECT account_id, leg_id, place FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY debit DESC, leg_id) AS place FROM legs WHERE debit > 0) WHERE place <= 3",
)
