"""Printed statements: the ledger's pools of accounts written as text files in five layouts, and read back by lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..plans.fixpoint import shared_folder, shuffles_freed
from ..sources.ledger_view import LEGS_SQL, bare_legs, dressed
from ..sources.lines import PARSERS, kinds, numbered_lines, parse_texts

POOLS = 40
_POOL = f"CAST(substr(account_id, 4, 5) AS INT) % {POOLS}"
_KIND = "CASE pool % 5 WHEN 0 THEN 'wrapped' WHEN 1 THEN 'report' WHEN 2 THEN 'table' WHEN 3 THEN 'columns' ELSE 'text' END"


def pooled(ledger: DataFrame) -> DataFrame:
    """Rows with the pool of their account and the pool's running balance; bare legs get their texts after the sums, which shuffle less so."""
    rows = ledger.withColumn("pool", F.expr(_POOL))
    upto = Window.partitionBy("pool").orderBy("ts", "leg_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("balance", (F.sum(F.col("credit") - F.col("debit")).over(upto) + 1_000_000_000).cast("decimal(28,2)"))
    return (rows if "utr_ref" in rows.columns else dressed(rows)).withColumn("kind", F.expr(_KIND)).withColumn("amount", F.greatest("debit", "credit"))


def printed(ledger: DataFrame) -> DataFrame:
    """(source_file, part, ts, leg_id, k, line) of all pools: head, rows and foot."""
    day = lambda f: F.date_format("ts", f)
    is_ = lambda kind: F.col("kind") == kind
    told = F.concat_ws(" ", "channel", "cp")
    amount, balance = F.col("amount").cast("string"), F.col("balance").cast("string")
    early = F.col("rid") % 2 == 0
    lines = (
        F.when(is_("wrapped"), F.array(F.concat_ws(" ", day("dd-MM-yyyy"), told, F.when(early, amount), F.concat(balance, F.lit("CR"))), F.concat_ws(" ", F.lit("Ref"), "utr_ref", F.when(~early, amount))))
        .when(is_("report"), F.array(F.concat_ws("  ", day("dd-MM-yyyy"), day("dd-MM-yyyy"), "utr_ref", told, amount, F.concat(balance, F.lit("Cr CDCI")), F.lit("V1"))))
        .when(is_("table"), F.array_compact(F.array(F.when(F.col("rid") % 3 == 0, F.concat_ws(" ", F.lit("Transfer note"), "utr_ref")), F.concat_ws(" ", F.upper(day("dd-MMM-yyyy")), F.upper(day("dd-MMM-yyyy")), told, F.col("debit").cast("string"), F.col("credit").cast("string"), balance))))
        .when(is_("columns"), F.array(F.concat_ws("  ", day("dd/MM/yyyy"), told, F.concat(amount, F.when(F.col("credit") > 0, "CR").otherwise("DR")), balance)))
        .otherwise(F.array_compact(F.array(F.concat_ws("  ", day("dd/MM/yyyy"), told, "utr_ref", F.col("debit").cast("string"), F.col("credit").cast("string"), balance), F.when(F.col("rid") % 7 == 0, F.concat_ws(" ", F.lit("CONT"), "utr_ref")))))
    )
    file = F.concat("kind", F.lit("-"), F.lpad(F.col("pool").cast("string"), 2, "0"), F.lit(".txt"))
    rows = pooled(ledger).select(file.alias("source_file"), F.lit(1).alias("part"), "ts", "leg_id", F.posexplode(lines).alias("k", "line"))
    heads = {"wrapped": ["STATEMENT OF ACCOUNT", "Opening Balance 1000000000.00"], "report": ["Customer Account Ledger Report", "B/F Balance : 1000000000.00CR", "GL. Date  Value Date  Instrmnt Number  Particulars"], "table": ["STATEMENT OF ACCOUNT", "TXN DATE VALUE DATE DESCRIPTION"], "columns": ["Gramin statement"], "text": ["Account statement", "", "Txn Date  Narration  Ref No  Debit  Credit  Balance"]}
    head = F.coalesce(*(F.when(F.col("source_file").startswith(f"{k}-"), F.array(*map(F.lit, v))) for k, v in heads.items()))
    files = rows.select("source_file").distinct()
    none = [F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("leg_id")]
    above = files.select("source_file", F.lit(0).alias("part"), *none, F.posexplode(head).alias("k", "line"))
    below = files.select("source_file", F.lit(2).alias("part"), *none, F.lit(0).alias("k"), F.lit("Page Total and Closing Balance").alias("line"))
    return rows.unionByName(above).unionByName(below)


def write_files(lines: DataFrame) -> str:
    """Writes a text file for each source_file below a new folder of the shared storage and returns the folder."""
    path = f"{shared_folder(lines.sparkSession)}/printed-{uuid.uuid4().hex}"
    ordered = lines.repartition("source_file").sortWithinPartitions("source_file", "part", "ts", "leg_id", "k")
    with shuffles_freed(lines.sparkSession):
        ordered.select("source_file", "line").write.partitionBy("source_file").text(path)
    return path


def read_files(spark, path: str) -> DataFrame:
    return numbered_lines(spark, path).withColumn("source_file", F.regexp_extract("source_file", "source_file=([^/]+)/", 1))


def _lines(s, d, kind=None):
    lines = read_files(s, write_files(printed(bare_legs(s, d))))
    return lines if kind is None else lines.filter(F.col("source_file").startswith(kind))


_SHOWN = ["source_file", "date", "narration", "debit", "credit", "balance"]
_ROWS = f"""WITH {LEGS_SQL}, p AS (SELECT *, {_POOL} AS pool FROM legs),
b AS (SELECT *, {_KIND} AS kind, greatest(debit, credit) AS amount, CAST(sum(credit - debit) OVER (PARTITION BY pool ORDER BY ts, leg_id ROWS UNBOUNDED PRECEDING) + 1000000000 AS decimal(28,2)) AS balance, row_number() OVER (PARTITION BY pool ORDER BY ts, leg_id) AS k, channel || ' ' || cp AS told FROM p),
r AS (SELECT * REPLACE (kind || '-' || lpad(CAST(pool AS VARCHAR), 2, '0') || '.txt' AS source_file) FROM b)"""
_D, _T = "strftime(ts, '%d-%m-%Y') AS date", "strftime(ts, '%d/%m/%Y') AS date"
_READ = {
    "wrapped": f"SELECT source_file, {_D}, told || ' Ref ' || utr_ref AS narration, CASE WHEN k = 1 THEN 0.0 ELSE CAST(debit AS DOUBLE) END AS debit, CASE WHEN k = 1 THEN CAST(amount AS DOUBLE) ELSE CAST(credit AS DOUBLE) END AS credit, balance || 'CR' AS balance FROM r WHERE kind = 'wrapped'",
    "report": f"SELECT source_file, {_D}, utr_ref || ' ' || told AS narration, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit, balance || 'Cr' AS balance FROM r WHERE kind = 'report'",
    "table": "SELECT source_file, upper(strftime(ts, '%d-%b-%Y')) AS date, CASE WHEN rid % 3 = 0 THEN 'Transfer note ' || utr_ref || ' ' ELSE '' END || told AS narration, CAST(debit AS VARCHAR) AS debit, CAST(credit AS VARCHAR) AS credit, CAST(balance AS VARCHAR) AS balance FROM r WHERE kind = 'table'",
    "columns": f"SELECT source_file, {_T}, told AS narration, CASE WHEN credit > 0 THEN '' ELSE amount || 'DR' END AS debit, CASE WHEN credit > 0 THEN amount || 'CR' ELSE '' END AS credit, CAST(balance AS VARCHAR) AS balance FROM r WHERE kind = 'columns'",
    "text": f"SELECT source_file, {_T}, told AS narration, CAST(debit AS VARCHAR) AS debit, CAST(credit AS VARCHAR) AS credit, balance || CASE WHEN rid % 7 = 0 THEN ' CONT ' || utr_ref ELSE '' END AS balance FROM r WHERE kind = 'text'",
}
for _name, _kind in (("src_wrapped", "wrapped"), ("src_pnb_ledger", "report"), ("src_yesbank", "table"), ("src_gramin", "columns"), ("src_textline", "text")):
    register(_name, lambda s, d, k=_kind: PARSERS[k](_lines(s, d, k)).select(_SHOWN), f"{_ROWS} {_READ[_kind]}")
register(
    "src_txt",
    lambda s, d: parse_texts(_lines(s, d)).select("source_file", "kind", "date", "narration", "balance"),
    f"{_ROWS} " + " UNION ALL ".join(f"SELECT source_file, '{k}' AS kind, date, narration, balance FROM ({q}) {k}_" for k, q in _READ.items()),
)
register(
    "src_dir",
    lambda s, d: (lambda lines: kinds(lines).join(lines.groupBy("source_file").agg(F.count("*").alias("n_lines"), F.max("line_no").alias("last_line")), "source_file"))(_lines(s, d)),
    f"{_ROWS}, sized AS (SELECT source_file, kind, sum(CASE WHEN kind = 'wrapped' THEN 2 WHEN kind = 'table' AND rid % 3 = 0 THEN 2 WHEN kind = 'text' AND rid % 7 = 0 THEN 2 ELSE 1 END) + 1 + CASE kind WHEN 'wrapped' THEN 2 WHEN 'report' THEN 3 WHEN 'table' THEN 2 WHEN 'columns' THEN 1 ELSE 3 END AS n FROM r GROUP BY 1, 2) SELECT source_file, kind, CAST(n AS BIGINT) AS n_lines, CAST(n AS BIGINT) AS last_line FROM sized",
)
