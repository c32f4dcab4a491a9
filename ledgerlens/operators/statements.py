"""Statement files of each account and month, made from the ledger and read back through the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import register
from ..sources.files import dispatch, parse_delimited, parse_json
from ..sources.ledger_view import LEGS_SQL, legs


#: Every fifth narration has a comma and quotes, which a delimited file must quote.
_TOLD = "CASE WHEN rid % 5 = 0 THEN concat(narration, ', \"x\"') ELSE narration END"
_FILE = "concat(account_id, '-', substr(date, 1, 7))"


def as_csv(ledger: DataFrame) -> DataFrame:
    """A text for each account and month: a preamble of four lines, a header and the rows; tabs for every other account, else commas."""
    tabbed = F.substring("account_id", 8, 1).cast("int") % 2 == 0
    both = lambda *cells: F.when(tabbed, F.concat_ws("\t", *cells)).otherwise(F.concat_ws(",", *cells))
    told = F.concat(F.lit('"'), F.replace(F.expr(_TOLD), F.lit('"'), F.lit('""')), F.lit('"'))
    row = both("date", told, "utr_ref", F.col("debit").cast("string"), F.col("credit").cast("string"))
    rows = ledger.groupBy("account_id", F.expr(_FILE).alias("file")).agg(F.array_sort(F.collect_list(F.struct("leg_id", row.alias("row")))).alias("rows"))
    header = both(*map(F.lit, ["Txn Date", "Particulars", "Ref No.", "Debit", "Credit"]))
    return rows.select(F.concat("file", F.lit(".csv")).alias("source_file"), F.concat_ws("\n", F.lit("Bank of Examples"), F.concat(F.lit("Account: "), "account_id"), F.lit("Statement of debits"), F.lit(""), header, F.array_join(F.col("rows")["row"], "\n"), F.lit("cut off")).alias("content"))


def as_json(ledger: DataFrame) -> DataFrame:
    item = F.struct("leg_id", F.struct("date", F.expr(_TOLD).alias("narration"), "utr_ref", F.col("debit").cast("string").alias("debit"), F.col("credit").cast("string").alias("credit")).alias("t"))
    rows = ledger.groupBy("account_id", F.expr(_FILE).alias("file")).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    listed = F.col("rows")["t"]
    wrapped = F.substring("account_id", 8, 1).cast("int") % 2 == 0
    return rows.select(F.concat("file", F.lit(".json")).alias("source_file"), F.when(wrapped, F.to_json(F.struct(listed.alias("transactions")))).otherwise(F.to_json(listed)).alias("content"))


def upload(ledger: DataFrame) -> DataFrame:
    """Files of several kinds: by an account's last digit CSV (0 to 3), JSON (4 to 6), an empty CSV (7), cut JSON (8) or one that nothing reads (9)."""
    digit = F.substring("account_id", 8, 1).cast("int")
    bare = ledger.filter(digit >= 7).select("account_id", F.expr(_FILE).alias("file")).distinct()
    others = bare.select(F.concat("file", F.when(digit == 7, ".csv").when(digit == 8, ".json").otherwise(".dat")).alias("source_file"), F.when(digit == 7, "").when(digit == 8, '{"transactions": [{"date": ').otherwise("?").alias("content"))
    return as_csv(ledger.filter(digit <= 3)).unionByName(as_json(ledger.filter(digit.between(4, 6)))).unionByName(others)


_COLUMNS = ["source_file", "date", "narration", "utr_ref", "debit", "credit"]
_ROWS = f"{_TOLD} AS narration, utr_ref, CAST(debit AS VARCHAR) AS debit, CAST(credit AS VARCHAR) AS credit FROM legs"
register("src_csv", lambda s, d: parse_delimited(as_csv(legs(s, d))).select(_COLUMNS), f"WITH {LEGS_SQL} SELECT {_FILE} || '.csv' AS source_file, date, {_ROWS}")
register("src_json", lambda s, d: parse_json(as_json(legs(s, d))).select(_COLUMNS), f"WITH {LEGS_SQL} SELECT {_FILE} || '.json' AS source_file, date, {_ROWS}")
register(
    "src_dispatch",
    lambda s, d: dispatch(upload(legs(s, d))),
    f"""WITH {LEGS_SQL}, files AS (SELECT {_FILE} AS file, CAST(substr(account_id, 8, 1) AS INT) AS digit, count(*) AS n FROM legs GROUP BY 1, 2)
SELECT file || CASE WHEN digit <= 3 OR digit = 7 THEN '.csv' WHEN digit <= 6 OR digit = 8 THEN '.json' ELSE '.dat' END AS source_file, CASE WHEN digit <= 6 THEN n ELSE 0 END AS n_rows, CASE WHEN digit <= 6 THEN 'ok' WHEN digit = 7 THEN 'empty' ELSE 'error' END AS status FROM files""",
)
