"""Statements printed as lines of text: files are read by lines, in splits, and rows are told from runs of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import checkpointed
from .files import ROLES, role_of

#: Words of a header, and beginnings or words of lines that aren't rows.
HEADER_WORDS = ["date", "debit", "credit", "balance", "narration", "description", "withdrawal", "deposit", "particulars", "remarks", "amount", "ref", "cheque", "txn", "post"]
WRAPPED_STOPS = ["Page", "Statement", "Closing Balance", "***", "Generated", "Opening Balance", "STATEMENT OF ACCOUNT", "DATE "]
REPORT_STOPS = ["Page Total", "Total Credit", "Total Debit", "Closing Balance", "Signature", "Order by", "*", "Date ", "GL."]
TABLE_STOPS = ["TXN DATE", "VALUE DATE", "DESCRIPTION", "REFERENCE", "STATEMENT OF ACCOUNT", "CUSTOMER ID", "ACCOUNT NO", "PERIOD", "OPENING BALANCE", "CLOSING BALANCE", "PAGE"]
LISTED_STOPS = ["PAGE", "TOTAL", "CLOSING BALANCE", "OPENING BALANCE", "HELPLINE", "BRANCH", "MICR", "IFSC"]
DATED_STOPS = ["Id Date", "Total(", "Total ", "Closing Balance", "Manager/", "Date :", "***", "Report for the Period", "Service OutLet"]
TEXT_STOPS = ["account holder", "ifsc", "page", "statement period", "generated"]

AMOUNT = r"(?i)^[\d,]+\.\d{2}(CR|DR)?$"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line_no, line) of all text files below a path; source_file is the path below it.

    A file's splits may be read by any task: lines are counted within each split, and splits follow each other by their
    offset, so no task sees a whole file.
    """
    root = path.rstrip("/").rsplit("/", 1)[-1]
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    raw = checkpointed(raw.select(F.regexp_extract(F.col("_metadata.file_path"), f"/{root}/(.*)$", 1).alias("source_file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"), F.col("value").alias("line")))
    splits = raw.groupBy("source_file", "at").agg(F.count("*").alias("n"))
    before = splits.withColumn("before", F.sum("n").over(Window.partitionBy("source_file").orderBy("at")) - F.col("n")).drop("n")
    numbered = raw.withColumn("no", F.row_number().over(Window.partitionBy("source_file", "at").orderBy("k")))
    return numbered.join(before, ["source_file", "at"]).select("source_file", (F.col("no") + F.col("before")).alias("line_no"), "line")


def in_file():
    return Window.partitionBy("source_file").orderBy("line_no")


def starts_with(line: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | line.startswith(w)
    return out


def holds(line: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(line, F.lit(w))
    return out


def amount_of(token: Column) -> Column:
    """The number of an amount without its sign's letters; 0 where there is none."""
    return F.coalesce(F.replace(F.regexp_replace(token, r"(?i)\s*\(?(CR|DR)\)?\s*$", ""), F.lit(",")).try_cast("double"), F.lit(0.0))


def _directed(rows: DataFrame, amount: Column, before: Column) -> DataFrame:
    """Adds debit and credit: an amount is a debit where the balance fell since the row before, else a credit."""
    fell = F.col("balance_value") < before - 1e-6
    amount = F.coalesce(amount, F.lit(0.0))
    return rows.withColumns({"debit": F.when(fell, amount).otherwise(0.0), "credit": F.when(F.coalesce(fell, F.lit(False)), 0.0).otherwise(amount)})


def parse_wrapped(lines: DataFrame) -> DataFrame:
    """(source_file, line_no, date, narration, debit, credit, balance): a row from each line that begins with a date to the next.

    The balance is the run's last amount with Cr or Dr behind it, the amount its last one without; the narration is
    what else there is.  Runs without a balance give no row.
    """
    pattern = r"(?i)([\d,]+\.\d{2}\s*(?:CR|DR)?)"
    rows = lines.withColumn("line", F.trim("line")).filter("line <> ''").withColumn("date", F.regexp_extract("line", r"^(\d{2}-\d{2}-\d{4})\b", 1))
    rows = rows.withColumn("run", F.count_if(F.col("date") != "").over(in_file())).filter((F.col("date") != "") | (F.col("run") > 0) & ~starts_with(F.col("line"), WRAPPED_STOPS))
    piece = F.when(F.col("date") != "", F.trim(F.substring("line", F.lit(11), F.length("line")))).otherwise(F.col("line"))
    runs = rows.groupBy("source_file", "run").agg(F.min("line_no").alias("line_no"), F.max("date").alias("date"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", piece.alias("piece")))), lambda x: x["piece"]), " ").alias("text"))
    tokens = F.transform(F.regexp_extract_all("text", F.lit(pattern), 1), lambda t: F.trim(t))
    signed = lambda t: t.rlike("(?i)(CR|DR)$")
    found = runs.withColumn("tokens", tokens).select("*", F.try_element_at(F.filter("tokens", signed), F.lit(-1)).alias("balance"), F.try_element_at(F.filter("tokens", lambda t: ~signed(t)), F.lit(-1)).alias("amount")).filter("balance is not null")
    found = found.withColumn("balance_value", amount_of(F.col("balance")))
    told = F.trim(F.regexp_replace(F.regexp_replace("text", pattern, ""), r"\s+", " "))
    return _directed(found, amount_of(F.col("amount")), F.lag("balance_value").over(in_file())).select("source_file", "line_no", "date", told.alias("narration"), "debit", "credit", "balance")


def parse_report(lines: DataFrame) -> DataFrame:
    """Rows of a ledger report: two dates, a narration, one amount or two, a balance and user names, parted by two blanks or more.

    An opening balance counts as the row before the first.
    """
    line = F.trim("line")
    opening = line.startswith("B/F Balance") | F.contains(line, F.lit("Opening Balance"))
    tail = F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))
    glued = r"(?i)^([\d,]+\.\d{2}(?:CR|DR))\s+(\S.*)$"
    parts = F.filter(F.split(line, r"\s{2,}"), lambda p: p != "")
    parts = F.flatten(F.transform(parts, lambda p: F.when(p.rlike(glued), F.array(F.regexp_extract(p, glued, 1), F.regexp_extract(p, glued, 2))).otherwise(F.array(p))))
    rows = lines.withColumns({"opening": opening, "tail": tail, "parts": parts, "stop": starts_with(line, REPORT_STOPS)})
    date = r"^\d{2}-\d{2}-\d{4}$"
    at = lambda xs, k: F.try_element_at(xs, F.lit(k))
    is_row = ~F.col("opening") & ~F.col("stop") & (F.size("parts") >= 5) & at(F.col("parts"), 1).rlike(date) & at(F.col("parts"), 2).rlike(date)
    rest = F.slice("parts", F.lit(3), F.greatest(F.size("parts") - 2, F.lit(0)))
    amount_at = lambda xs, k: F.coalesce(at(xs, k).rlike(AMOUNT), F.lit(False))
    rows = rows.withColumn("is_row", is_row).filter("is_row or opening").withColumn("rest", rest)
    names = F.when(amount_at(F.col("rest"), -1), 0).when(~amount_at(F.col("rest"), -2) & (F.size("rest") >= 2), 2).otherwise(1)
    rows = rows.withColumn("rest", F.slice("rest", F.lit(1), F.greatest(F.size("rest") - names, F.lit(0)))).filter(F.col("opening") & F.col("tail").rlike(AMOUNT) | F.col("is_row") & amount_at(F.col("rest"), -1))
    rows = rows.withColumn("balance", F.when(F.col("opening"), F.col("tail")).otherwise(at(F.col("rest"), -1))).withColumn("balance_value", amount_of(F.col("balance")))
    body = F.slice("rest", F.lit(1), F.greatest(F.size("rest") - 1, F.lit(0)))
    # The amounts stand behind the last part that is none.
    words = F.coalesce(F.array_max(F.transform(F.sequence(F.lit(1), F.size("body")), lambda k: F.when(~F.get("body", k - 1).rlike(AMOUNT), k).otherwise(0))), F.lit(0))
    rows = rows.withColumn("body", body).withColumn("words", F.when(F.size("body") > 0, words).otherwise(0)).withColumn("amounts", F.slice("body", F.col("words") + 1, F.size("body")))
    one = _directed(rows, amount_of(F.get("amounts", 0)), F.lag("balance_value").over(in_file())).filter("is_row")
    two = F.size("amounts") >= 2
    return one.select("source_file", "line_no", at(F.col("parts"), 1).alias("date"), F.array_join(F.slice("body", F.lit(1), F.col("words")), " ").alias("narration"), F.when(two, amount_of(F.get("amounts", 0))).otherwise(F.col("debit")).alias("debit"), F.when(two, amount_of(F.get("amounts", 1))).otherwise(F.col("credit")).alias("credit"), "balance")


def _with_text_before(rows: DataFrame) -> DataFrame:
    """(source_file, run, before, line, line_no): each line with is_row, and the lines with is_text right before it as one text."""
    # A run is lines of text and the line that ends them.
    run = F.coalesce(F.count_if(~F.col("is_text")).over(in_file().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = F.transform(F.sort_array(F.collect_list(F.when(F.col("is_text"), F.struct("line_no", "line")))), lambda x: x["line"])
    runs = rows.withColumn("run", run).groupBy("source_file", "run").agg(F.array_join(told, " ").alias("before"), F.max(F.when(F.col("is_row"), F.col("line"))).alias("line"), F.max("line_no").alias("line_no"))
    return runs.filter("line is not null")


def parse_table(lines: DataFrame) -> DataFrame:
    """Rows of two dates, a narration, debit, credit and balance on one line; lines of text right before it belong to its narration."""
    pattern = r"^(\d{2}-[A-Z]{3}-\d{4})\s+(\d{2}-[A-Z]{3}-\d{4})\s+(.+?)\s+([\d,]+\.\d{2})\s+([\d,]+\.\d{2})\s+([\d,]+\.\d{2})$"
    rows = lines.withColumn("line", F.trim("line")).filter("line <> ''")
    is_row = F.col("line").rlike(pattern) & ~holds(F.upper("line"), TABLE_STOPS)
    is_text = ~is_row & ~holds(F.upper("line"), TABLE_STOPS) & (F.length("line") > 5) & ~F.col("line").rlike(r"^[\d,]+\.\d{2}") & ~F.col("line").rlike(r"^\d{2}-[A-Z]{3}")
    runs = _with_text_before(rows.withColumns({"is_row": is_row, "is_text": is_text}))
    cell = lambda k: F.regexp_extract("line", pattern, k)
    return runs.select("source_file", "line_no", cell(1).alias("date"), F.trim(F.concat("before", F.lit(" "), cell(3))).alias("narration"), cell(4).alias("debit"), cell(5).alias("credit"), cell(6).alias("balance"))


def parse_listed(lines: DataFrame) -> DataFrame:
    """Rows of a date, a narration and three amounts or two, below a header; lines of text right before a row belong to its narration.

    With two amounts the first isn't told to be a debit or a credit, so both stay empty and the last is the balance.
    """
    three = r"^(\d{2}-\d{2}-\d{2,4})\s+(.+?)\s+([\d,]+\.\d{2})\s+([\d,]+\.\d{2})\s+([\d,]+\.\d{2})(?:Cr|Dr)?$"
    two = r"^(\d{2}-\d{2}-\d{2,4})\s+(.+?)\s+([\d,]+\.\d{2})(?:Cr|Dr)?\s+([\d,]+\.\d{2})(?:Cr|Dr)?$"
    line = F.col("line")
    rows = lines.withColumn("line", F.trim("line")).filter("line <> '' and line not rlike '^-+$'")
    head = F.contains(line, F.lit("DATE")) & holds(line, ["WITHDRAWAL", "PARTICULARS"])
    rows = rows.withColumns({"head": head, "below": F.count_if(head).over(in_file()) > 0}).filter(F.col("below") & ~F.col("head") & ~holds(F.upper("line"), LISTED_STOPS))
    is_row = line.rlike(three) | line.rlike(two)
    runs = _with_text_before(rows.withColumns({"is_row": is_row, "is_text": ~is_row & ~line.rlike(r"^\d{2}-\d{2}") & (F.length("line") > 3)}))
    full = line.rlike(three)
    cell = lambda k, or_two: F.when(full, F.regexp_extract("line", three, k)).otherwise(or_two)
    of_two = lambda k: F.regexp_extract("line", two, k)
    told = F.trim(F.concat("before", F.lit(" "), cell(2, of_two(2))))
    return runs.select("source_file", "line_no", F.substring_index("line", " ", 1).alias("date"), told.alias("narration"), cell(3, "").alias("debit"), cell(4, "").alias("credit"), cell(5, of_two(4)).alias("balance"))


def parse_dated(lines: DataFrame) -> DataFrame:
    """Rows of a date (or two), words, and amounts at the end, the last of which is the balance; it may stand alone on the next line.

    Rows begin below a header, an opening balance, or with the first line that is a row with two amounts.  One amount
    before the balance is a debit where the balance fell since the row or the opening balance before it; without any
    before, where the balance is overdrawn.  Of two amounts with signs the first counts, as the second's sign says; without
    signs the second is the credit.  Letters glued to the date are the reference.
    """
    bare, amount = r"(?i)^[\d,]+\.\d{2}\s*(?:CR|DR)?$", r"(?i)^[\d,]+\.\d{2}(?:\(?(?:CR|DR)\)?)?$"
    row = r"^(\d{2}[-/]\d{2}[-/]\d{2,4})(?:\s+\d{2}[-/]\d{2}[-/]\d{2,4})?(\S*)\s+(.+)$"
    line, low = F.col("line"), F.lower("line")
    # A sign in brackets belongs to the amount before it.
    rows = lines.withColumn("line", F.regexp_replace(F.trim("line"), r"(?i)(\d)\s+(\((?:CR|DR)\))", "$1$2")).filter("line <> ''")
    opening = F.contains(low, F.lit("opening balance")) | F.contains(low, F.lit("brought forward")) | line.startswith("B/F")
    tokens = F.split(F.regexp_extract("line", row, 3), r"\s+")
    words = F.coalesce(F.array_max(F.transform(F.sequence(F.lit(1), F.size("tokens")), lambda k: F.when(~F.get("tokens", k - 1).rlike(amount), k).otherwise(0))), F.lit(0))
    rows = rows.withColumns({"opening": opening, "tokens": F.when(line.rlike(row), tokens).otherwise(F.array().cast("array<string>"))})
    rows = rows.withColumn("words", F.when(F.size("tokens") > 0, words).otherwise(0))
    rows = rows.withColumn("amounts", F.slice("tokens", F.col("words") + 1, F.size("tokens")))
    stop = starts_with(line, DATED_STOPS) | line.rlike(r"^\.") | F.contains(line, F.lit("Page"))
    head = F.contains(low, F.lit("date")) & holds(low, ["withdraw", "deposit", "debit", "credit", "amount", "balance", "particular"])
    begins = head | F.col("opening") | (F.size("amounts") >= 2)
    next_line = F.lead("line").over(in_file())
    rows = rows.withColumns({"stop": stop, "below": F.count_if(begins).over(in_file()) > 0, "wrapped": F.when((F.size("amounts") == 1) & next_line.rlike(bare), next_line)})
    is_row = ~F.col("stop") & ~F.col("opening") & ((F.size("amounts") >= 2) | F.col("wrapped").isNotNull())
    tail = F.regexp_extract("line", r"(?i)([\d,]+\.\d{2}(?:\(?(?:CR|DR)\)?)?)$", 1)
    rows = rows.withColumn("is_row", is_row).filter(F.col("below") & (F.col("is_row") | F.col("opening") & (tail != "")))
    at = lambda k: F.try_element_at("amounts", F.lit(k))
    n = F.size("amounts") - F.when(F.col("wrapped").isNull(), 1).otherwise(0)
    rows = rows.withColumns({"balance": F.when(F.col("opening"), tail).otherwise(F.coalesce("wrapped", at(-1))), "n": n})
    rows = rows.withColumn("balance_value", amount_of(F.col("balance")))
    before = F.lag("balance_value").over(in_file())
    overdrawn = F.col("balance").rlike(r"(?i)DR\)?$")
    signed = lambda c, word: F.coalesce(c.rlike(rf"(?i){word}\)?$"), F.lit(False))
    first, second = F.when(F.col("wrapped").isNull(), at(-3)).otherwise(at(-2)), F.when(F.col("wrapped").isNull(), at(-2)).otherwise(at(-1))
    debit = F.when(F.col("n") == 1, F.coalesce(F.col("balance_value") < before - 1e-6, overdrawn)).otherwise(signed(second, "DR"))
    value = F.when(F.col("n") == 1, amount_of(second)).when(signed(first, "(CR|DR)") | signed(second, "(CR|DR)"), amount_of(first)).otherwise(amount_of(second))
    rows = rows.withColumns({"is_debit": debit, "value": value}).filter("is_row")
    code = F.regexp_extract("line", row, 2)
    told = F.regexp_replace(F.array_join(F.slice("tokens", F.lit(1), F.col("words")), " "), r"(?:(?:^|\s)[.\-])+$", "")
    return rows.select(
        "source_file", "line_no", F.regexp_extract("line", row, 1).alias("date"), F.trim(told).alias("narration"), F.when(F.col("is_debit"), F.col("value")).otherwise(0.0).alias("debit"),
        F.when(F.col("is_debit"), 0.0).otherwise(F.col("value")).alias("credit"), "balance", F.when(code.rlike("^[A-Za-z1-9][A-Za-z0-9]*$"), code).otherwise("").alias("utr_ref"),
    )


def parse_columns(lines: DataFrame) -> DataFrame:
    """Rows that begin with a date and end in amounts, parted by tabs or two blanks; Cr and Dr tell the side, else it is a credit."""
    has = lambda c: F.coalesce(c.rlike(r"[\d,]+\.\d{2}"), F.lit(False))
    rows = lines.withColumn("line", F.trim("line")).filter(F.col("line").rlike(r"^\d{1,2}[-/ ]\d{1,2}[-/ ]\d{2,4}"))
    parts = F.split("line", r"\t|\s{2,}")
    rows = rows.withColumn("parts", F.when(F.size(parts) <= 1, F.split("line", r"\s+")).otherwise(parts)).withColumn("n", F.size("parts"))
    last, second = F.element_at("parts", -1), F.try_element_at("parts", F.lit(-2))
    full = (F.col("n") >= 3) & has(last)
    four = full & (F.col("n") >= 4) & has(second)
    amount = F.when(full, second).when((F.col("n") >= 2) & has(last), last)
    behind = F.when(four, 2).otherwise(1)
    rows = rows.withColumns({"amount": amount, "balance": F.when(full, last).otherwise(""), "narration": F.trim(F.array_join(F.slice("parts", F.lit(2), F.greatest(F.col("n") - 1 - behind, F.lit(0))), " "))}).filter(has(F.col("amount")))
    side = lambda word: F.col("amount").rlike(word) | F.col("balance").rlike(word)
    credit = side(r"CR$|Cr$|CR\b") | ~side(r"DR$|Dr$|DR\b")
    return rows.select("source_file", "line_no", F.element_at("parts", 1).alias("date"), "narration", F.when(credit, "").otherwise(F.col("amount")).alias("debit"), F.when(credit, F.col("amount")).otherwise("").alias("credit"), "balance")


def parse_text(lines: DataFrame) -> DataFrame:
    """Rows below a header of three known words or more, parted by two blanks; a line without a date goes on with the line before.

    The header is the file's first such line and needs four names.  Rows may have three cells more or fewer than it.
    """
    hits = sum((F.contains(F.lower("line"), F.lit(w)).cast("int") for w in HEADER_WORDS), F.lit(0))
    first = lines.filter(hits >= 3).groupBy("source_file").agg(F.min_by(F.struct(F.col("line_no").alias("head"), F.col("line").alias("names")), "line_no").alias("h")).select("source_file", "h.*")
    cells = lambda c: F.filter(F.transform(F.split(c, r"\s{2,}"), lambda p: F.trim(p)), lambda p: p != "")
    first = first.withColumn("names", cells(F.col("names"))).filter(F.size("names") >= 4).withColumn("roles", F.transform("names", role_of))
    rows = lines.join(first, "source_file").filter((F.col("line_no") > F.col("head")) & (F.length("line") >= 8) & ~holds(F.lower("line"), TEXT_STOPS)).withColumn("line", F.trim("line"))
    run = F.count_if(F.col("line").rlike(r"^[0-3]?\d/[0-1]?\d/\d{2,4}\b")).over(in_file())
    runs = rows.withColumn("run", run).groupBy("source_file", "run").agg(F.first("roles").alias("roles"), F.min("line_no").alias("line_no"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("line"))
    runs = runs.withColumn("cells", cells(F.col("line"))).filter(F.abs(F.size("cells") - F.size("roles")) <= 3)
    value = lambda role: F.coalesce(F.get("cells", F.nullif(F.array_position("roles", role), F.lit(0)).cast("int") - 1), F.lit(""))
    return runs.select("source_file", "line_no", *(value(role).alias(role) for role in ROLES))


#: How a text file's kind is told: the first of these that some line of it shows.
KINDS = [
    ("report", r"B/F Balance|Instrmnt"),
    ("table", r"^\s*\d{2}-[A-Z]{3}-\d{4}\s+\d{2}-[A-Z]{3}-\d{4}\s"),
    ("listed", r"DATE.*(WITHDRAWAL|PARTICULARS)|(WITHDRAWAL|PARTICULARS).*DATE"),
    ("dated", r"(?i)^\s*B/F\s+\d|brought forward"),
    ("wrapped", r"^\s*\d{2}-\d{2}-\d{4}\b"),
    ("text", r"(?i)date\s{2,}.*(narration|particulars|description)"),
    ("columns", r"^\s*\d{1,2}[-/ ]\d{1,2}[-/ ]\d{2,4}"),
]
PARSERS = {"report": parse_report, "table": parse_table, "listed": parse_listed, "dated": parse_dated, "wrapped": parse_wrapped, "text": parse_text, "columns": parse_columns}


def kinds(lines: DataFrame) -> DataFrame:
    """(source_file, kind) of text files, null where no line tells one."""
    shows = [F.max(F.when(F.col("line").rlike(p), k)).alias(k) for k, p in KINDS]
    return lines.groupBy("source_file").agg(*shows).select("source_file", F.coalesce(*(k for k, _ in KINDS)).alias("kind"))


def parse_texts(lines: DataFrame) -> DataFrame:
    """(source_file, kind, line_no, date, narration, debit, credit, balance) of text files of any kind, all as text; each file goes to the one parser that its lines tell."""
    known = kinds(lines)
    parts = []
    for kind, parse in PARSERS.items():
        rows = parse(lines.join(known.filter(F.col("kind") == kind).select("source_file"), "source_file", "left_semi"))
        parts.append(rows.select("source_file", F.lit(kind).alias("kind"), "line_no", *(F.col(c).cast("string").alias(c) for c in ("date", "narration", "debit", "credit", "balance"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
