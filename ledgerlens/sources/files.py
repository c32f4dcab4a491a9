"""Bank statements as delimited text or JSON, read as whole files and taken apart by Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.fixpoint import checkpointed

#: Words that tell a column's role in a header, in the order of looking; the common ones, not every bank's.
ROLES = {
    "date": ["txn date", "transaction date", "tran date", "post date", "value date", "date"],
    "narration": ["narration", "description", "particulars", "remarks"],
    "utr_ref": ["ref no", "chq", "cheque", "instrument", "utr"],
    "debit": ["debit", "withdrawal"],
    "credit": ["credit", "deposit"],
    "balance": ["balance"],
}


def role_of(cell: Column) -> Column:
    """The role that a header cell names, or null."""
    s, case = F.lower(F.trim(cell)), None
    for role, words in ROLES.items():
        hit = s.rlike("|".join(w.replace(".", "\\.") for w in words))
        case = F.when(hit, role) if case is None else case.when(hit, role)
    return case


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, content) of all files below a path."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("content"))


def separator(line: Column) -> Column:
    """A tab, a pipe or a comma, whichever comes first in this list and is in the line."""
    return F.when(F.contains(line, F.lit("\t")), "\t").when(F.contains(line, F.lit("|")), "|").otherwise(",")


def cells(line: Column, by: Column) -> Column:
    """The cells of a line; a cell in double quotes may hold the separator, and two quotes for one."""
    found = lambda x: F.regexp_extract_all(F.concat(by, line), F.lit(rf'[{x}]("[^"]*(?:""[^"]*)*"|[^{x}]*)'), 1)
    bare = lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.length(c) > 1), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(F.trim(c))
    return F.transform(F.when(by == "\t", found(r"\t")).when(by == "|", found("|")).otherwise(found(",")), bare)


def parse_delimited(texts: DataFrame) -> DataFrame:
    """(source_file, content) to (source_file, line_no, date, narration, utr_ref, debit, credit, balance), all strings.

    The header is the first line that names three roles; what stands above it is dropped, and its separator holds for
    the file.  Rows with another number of cells than the header are skipped; a file without a header gives no rows.
    """
    # Only a line that holds words of three roles is taken apart to see whether its cells name them.
    held = lambda line: sum((F.lower(line).rlike("|".join(w.replace(".", "\\.") for w in words)).cast("int") for words in ROLES.values()), F.lit(0))
    named = lambda line: F.when(held(line) >= 3, F.size(F.array_distinct(F.array_compact(F.transform(cells(line, separator(line)), role_of))))).otherwise(0)
    # Lines know their places and the header is exploded, so neither is worked out again for every line by what is pushed below.
    lines = F.transform(F.split("content", "\r?\n"), lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("line")))
    at = texts.select("source_file", lines.alias("lines"))
    at = at.withColumn("header", F.explode(F.slice(F.filter("lines", lambda x: named(x["line"]) >= 3), 1, 1))).select("*", F.col("header.i").alias("head"), F.col("header.line").alias("names"))
    head = at.withColumn("by", separator(F.col("names"))).withColumn("roles", F.transform(cells(F.col("names"), F.col("by")), role_of))
    rows = head.select("source_file", "roles", "by", "head", F.posexplode(F.slice("lines", F.col("head") + 2, F.size("lines"))).alias("k", "x")).withColumn("line", F.col("x.line")).filter("line <> ''").withColumn("cells", cells(F.col("line"), F.col("by")))
    value = lambda role: F.get("cells", F.nullif(F.array_position("roles", role), F.lit(0)).cast("int") - 1)
    good = rows.filter(F.size("cells") == F.size("roles"))
    return good.select("source_file", (F.col("head") + 1 + F.col("k")).alias("line_no"), *(F.trim(value(role)).alias(role) for role in ROLES))


def parse_json(texts: DataFrame) -> DataFrame:
    """(source_file, content) of JSON lists of transactions, or of objects that hold one as `transactions`, to the same columns."""
    item = "struct<date:string,narration:string,utr_ref:string,debit:string,credit:string,balance:string>"
    listed = F.when(F.trim("content").startswith("["), F.from_json("content", f"array<{item}>")).otherwise(F.from_json("content", f"struct<transactions:array<{item}>>")["transactions"])
    return texts.select("source_file", F.posexplode(listed).alias("line_no", "t")).select("source_file", "line_no", "t.*")


def dispatch(texts: DataFrame) -> DataFrame:
    """(source_file, n_rows, status) of every file: read by its extension; ok, empty, or error where none reads it or its JSON is broken."""
    kind = F.lower(F.regexp_extract("source_file", r"\.([^./]+)$", 1))
    files = checkpointed(texts.withColumn("kind", kind))
    flat, nested = files.filter(F.col("kind").isin("csv", "tsv", "txt")), files.filter("kind = 'json'")
    n = parse_delimited(flat).select("source_file").unionByName(parse_json(nested).select("source_file")).groupBy("source_file").agg(F.count("*").alias("n"))
    broken = (F.col("kind") == "json") & F.try_parse_json("content").isNull()
    status = F.when(~F.col("kind").isin("csv", "tsv", "txt", "json") | broken, "error").when(F.col("n").isNull(), "empty").otherwise("ok")
    return files.join(n, "source_file", "left").select("source_file", F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"), status.alias("status"))
