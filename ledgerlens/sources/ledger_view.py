"""The ledger that the queries run on, derived from the driver's order tables.

Each order line is a transfer between two customers near to each other, within ninety days.  Its id is a digest of all
its columns, so no global order is needed; each transfer gives a debit leg and a credit leg that share a reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.fixpoint import checkpointed
from ..schema import MONEY

_COLUMNS = ["leg_id", "rid", "account_id", "cp", "debit", "credit", "ts", "date", "time", "channel", "utr_ref", "narration", "source_file"]
_MONEY_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, src, dst, amt, ts)."""
    n = table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    text = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *(F.col(c).cast("decimal(12,2)").cast("string") for c in _MONEY_COLUMNS), "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd")]
    h = F.expr("l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 1299709 + l_linenumber * 15485863 + cast(l_quantity as bigint) * 32452843")
    amt = F.expr("round(cast(l_extendedprice as decimal(12,2)) * (cast(1 as decimal(4,2)) - cast(l_discount as decimal(4,2))), 2)").cast(MONEY)
    # Lines meet their order with four short columns; h is only used modulo 12 and divided by 12 modulo 129600.
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.conv(F.substring(F.md5(F.concat_ws("|", *text)), 1, 15), 16, 10).cast("long").alias("rid"), (h % (12 * 129600)).cast("int").alias("h"), amt.alias("amt"))
    off = F.when(F.col("h") % 12 < 6, -(F.col("h") % 12) - 1).otherwise(F.col("h") % 12 - 5)
    base = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").crossJoin(F.broadcast(n)).withColumn("src", F.col("o_custkey") % F.col("n"))
    return base.select("rid", "src", ((F.col("src") + F.col("n") + off) % F.col("n")).alias("dst"), "amt", F.expr("timestampadd(MINUTE, cast(h div 12 as int), timestamp'2024-01-01')").alias("ts"))


def account(key):
    return F.concat(F.lit("A"), F.lpad(key.cast("string"), 7, "0"))


def bare_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(leg_id, rid, account_id, cp, debit, credit, ts) of both sides of every transfer."""
    return _sides(transfers(spark, sf_dir))


def _sides(t: DataFrame) -> DataFrame:
    src, dst = account(F.col("src")), account(F.col("dst"))
    zero = F.lit(0).cast(MONEY)
    side = lambda credit: F.struct((F.col("rid") * 2 + credit).alias("leg_id"), (dst if credit else src).alias("account_id"), (src if credit else dst).alias("cp"), (zero if credit else F.col("amt")).alias("debit"), (F.col("amt") if credit else zero).alias("credit"))
    both = t.select("rid", "ts", F.explode(F.array(side(0), side(1))).alias("leg")).select("rid", "ts", "leg.*")
    return both.select("leg_id", "rid", "account_id", "cp", "debit", "credit", "ts")


def dressed(both: DataFrame) -> DataFrame:
    """Adds to bare legs what follows from a row alone: (date, time, channel, utr_ref, narration, source_file).  What is shuffled or written before is short."""
    channels = F.array(*map(F.lit, ["UPI", "IMPS", "NEFT", "RTGS", "CASH", "ATM"]))
    channel = F.element_at(channels, (F.col("rid") % 6 + 1).cast("int"))
    utr = F.concat(F.lit("U"), F.col("rid").cast("string"))
    time = F.when(F.col("rid") % 10 == 0, "00:00:00").otherwise(F.date_format("ts", "HH:mm:ss"))
    return both.select("*", F.date_format("ts", "yyyy-MM-dd").alias("date"), time.alias("time"), channel.alias("channel"), utr.alias("utr_ref"), F.concat_ws("/", channel, utr, "cp", F.lit("PAY")).alias("narration"), F.concat(F.lit("F"), (F.col("rid") % 3).cast("string")).alias("source_file"))


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(leg_id, rid, account_id, cp, debit, credit, ts, date, time, channel, utr_ref, narration, source_file); time is unknown in a tenth of the rows."""
    return dressed(bare_legs(spark, sf_dir))


def balanced(ledger: DataFrame) -> DataFrame:
    """Adds a running balance, with planted gaps of 3 and 50, missing values, and accounts whose balance stands still."""
    upto = Window.partitionBy("account_id").orderBy("ts", "leg_id").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.when(F.col("rid") % 211 == 0, 50).when(F.col("rid") % 97 == 0, 3).otherwise(0)
    running = F.sum(F.col("credit") - F.col("debit") + gap.cast(MONEY)).over(upto) + F.lit(1000000).cast(MONEY)
    still = F.substring("account_id", 6, 3).cast("int") % 40 == 7
    balance = F.when(F.col("rid") % 53 == 0, F.lit(None)).when(still, F.lit(5000).cast(MONEY)).otherwise(running)
    return ledger.withColumn("balance", balance.cast("decimal(28,2)"))


def balanced_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """balanced(legs()), with balances found, and written once, before the rows get their texts and their second id."""
    found = checkpointed(balanced(bare_legs(spark, sf_dir)).withColumn("side", (F.col("leg_id") - F.col("rid") * 2).cast("int")).drop("leg_id"))
    return dressed(found.select((F.col("rid") * 2 + F.col("side")).alias("leg_id"), *(c for c in found.columns if c not in ("side", "balance")), "balance")).select(*_COLUMNS, "balance")


def written_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """legs() over transfers that are written once, for operators that read them several times."""
    return dressed(_sides(checkpointed(transfers(spark, sf_dir))))


#: The same views for the SQL oracle.
TRANSFERS_SQL = """
n AS (SELECT count(*) AS n FROM customer),
transfers AS (
  SELECT rid, src, (src + n + CASE WHEN h % 12 < 6 THEN -(h % 12) - 1 ELSE h % 12 - 5 END) % n AS dst, amt,
    timestamp '2024-01-01' + to_minutes((h // 12) % 129600) AS ts
  FROM (SELECT CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS decimal(12,2)), CAST(l_extendedprice AS decimal(12,2)),
      CAST(l_discount AS decimal(12,2)), CAST(l_tax AS decimal(12,2)), l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'))), 1, 15) AS BIGINT) AS rid,
    o_custkey % n AS src, n,
    l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 1299709 + l_linenumber * 15485863 + CAST(l_quantity AS BIGINT) * 32452843 AS h,
    CAST(round(CAST(l_extendedprice AS decimal(12,2)) * (CAST(1 AS decimal(4,2)) - CAST(l_discount AS decimal(4,2))), 2) AS decimal(18,2)) AS amt
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey CROSS JOIN n) x)"""

LEGS_SQL = (
    TRANSFERS_SQL
    + """,
legs AS (
  SELECT leg_id, rid, account_id, cp, debit, credit, ts, strftime(ts, '%Y-%m-%d') AS date,
    CASE WHEN rid % 10 = 0 THEN '00:00:00' ELSE strftime(ts, '%H:%M:%S') END AS time, channel, 'U' || rid AS utr_ref,
    channel || '/U' || rid || '/' || cp || '/PAY' AS narration, 'F' || (rid % 3) AS source_file
  FROM (SELECT *, ['UPI', 'IMPS', 'NEFT', 'RTGS', 'CASH', 'ATM'][rid % 6 + 1] AS channel FROM (
    SELECT rid * 2 AS leg_id, rid, 'A' || lpad(CAST(src AS VARCHAR), 7, '0') AS account_id, 'A' || lpad(CAST(dst AS VARCHAR), 7, '0') AS cp, amt AS debit, CAST(0 AS decimal(18,2)) AS credit, ts FROM transfers
    UNION ALL
    SELECT rid * 2 + 1, rid, 'A' || lpad(CAST(dst AS VARCHAR), 7, '0'), 'A' || lpad(CAST(src AS VARCHAR), 7, '0'), CAST(0 AS decimal(18,2)), amt, ts FROM transfers)) y)"""
)

BALANCED_SQL = (
    LEGS_SQL
    + """,
ledger AS (
  SELECT *, CAST(CASE WHEN rid % 53 = 0 THEN NULL WHEN CAST(substr(account_id, 6, 3) AS INT) % 40 = 7 THEN 5000
    ELSE 1000000 + sum(credit - debit + CASE WHEN rid % 211 = 0 THEN 50 WHEN rid % 97 = 0 THEN 3 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY ts, leg_id ROWS UNBOUNDED PRECEDING) END AS decimal(28,2)) AS balance
  FROM legs)"""
)
