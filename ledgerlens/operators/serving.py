"""Reads that a service makes: searches, pages, cards and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..sources.ledger_view import LEGS_SQL, legs, table



def card() -> list:
    return [F.count("*").alias("txn_count"), F.sum("debit").cast("double").alias("total_debit"), F.sum("credit").cast("double").alias("total_credit"), F.count_distinct("cp").alias("counterparties")]


def account_pages(ledger: DataFrame, size: int = 100) -> DataFrame:
    """All rows of every account in the order of a statement, with the page of `size` rows that each is on and the account's total."""
    order = Window.partitionBy("account_id").orderBy("date", "time", "leg_id")
    total = ledger.groupBy("account_id").agg(F.count("*").alias("total"))
    rows = ledger.withColumn("page", F.ceil(F.row_number().over(order) / size).cast("long")).join(total, "account_id")
    return rows.select("account_id", "page", "total", "leg_id", "date", "time", "cp", F.col("debit").cast("double").alias("debit"), F.col("credit").cast("double").alias("credit"), "channel")


_CARD_SQL = "count(*) AS txn_count, CAST(sum(debit) AS DOUBLE) AS total_debit, CAST(sum(credit) AS DOUBLE) AS total_credit, count(DISTINCT cp) AS counterparties"

register(
    "flt_txn_search",
    lambda s, d: legs(s, d).filter(F.col("narration").ilike("%upi%") & F.col("date").between("2024-01-10", "2024-02-10") & ((F.col("debit") >= 20000) | (F.col("credit") >= 20000))).select("leg_id", "account_id", "date", "channel"),
    f"WITH {LEGS_SQL} SELECT leg_id, account_id, date, channel FROM legs WHERE narration ILIKE '%upi%' AND date BETWEEN '2024-01-10' AND '2024-02-10' AND (debit >= 20000 OR credit >= 20000)",
)
register(
    "tk_page",
    lambda s, d: legs(s, d).orderBy(F.desc("date"), F.desc("time"), "leg_id").offset(100).limit(50).select("leg_id", "account_id", "date", "time"),
    f"WITH {LEGS_SQL} SELECT leg_id, account_id, date, time FROM legs ORDER BY date DESC, time DESC, leg_id LIMIT 50 OFFSET 100",
)
register("ag_account_card", lambda s, d: legs(s, d).groupBy("account_id").agg(*card()), f"WITH {LEGS_SQL} SELECT account_id, {_CARD_SQL} FROM legs GROUP BY 1")
register("ag_txn_stats", lambda s, d: legs(s, d).groupBy("channel").agg(F.count("*").alias("n"), F.sum(F.col("debit") + F.col("credit")).cast("double").alias("volume")), f"WITH {LEGS_SQL} SELECT channel, count(*) AS n, CAST(sum(debit + credit) AS DOUBLE) AS volume FROM legs GROUP BY 1")
register(
    "ag_dashboard",
    lambda s, d: legs(s, d).agg(F.count_distinct("account_id").alias("accounts"), F.count("*").alias("transactions"), F.sum("debit").cast("double").alias("debits"), F.count_distinct("channel").alias("channels"), F.min("date").alias("first_date"), F.max("date").alias("last_date")),
    f"WITH {LEGS_SQL} SELECT count(DISTINCT account_id) AS accounts, count(*) AS transactions, CAST(sum(debit) AS DOUBLE) AS debits, count(DISTINCT channel) AS channels, min(date) AS first_date, max(date) AS last_date FROM legs",
)
register(
    "ag_bounds",
    lambda s, d: legs(s, d).agg(F.min(F.col("debit") + F.col("credit")).cast("double").alias("least"), F.max(F.col("debit") + F.col("credit")).cast("double").alias("most"), F.min("ts").cast("string").alias("first"), F.max("ts").cast("string").alias("last")),
    f"WITH {LEGS_SQL} SELECT CAST(min(debit + credit) AS DOUBLE) AS least, CAST(max(debit + credit) AS DOUBLE) AS most, CAST(min(ts) AS VARCHAR) AS first, CAST(max(ts) AS VARCHAR) AS last FROM legs",
)
register(
    "flt_account_list",
    lambda s, d: table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).filter((F.col("c_acctbal") > 5000) & F.col("n_name").ilike("%a%")).select("c_custkey", "c_name", "n_name"),
    "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 AND n_name ILIKE '%a%'",
)
register(
    "sv_account_txns",
    lambda s, d: account_pages(legs(s, d)),
    f"WITH {LEGS_SQL} SELECT account_id, CAST(ceil(row_number() OVER (PARTITION BY account_id ORDER BY date, time, leg_id) / 100) AS BIGINT) AS page, count(*) OVER (PARTITION BY account_id) AS total, leg_id, date, time, cp, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit, channel FROM legs",
)
register(
    "sv_counterparties",
    lambda s, d: legs(s, d).groupBy("account_id", "cp").agg(F.count("*").alias("n"), F.max("date").alias("last_date")),
    f"WITH {LEGS_SQL} SELECT account_id, cp, count(*) AS n, max(date) AS last_date FROM legs GROUP BY 1, 2",
)
