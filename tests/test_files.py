"""Lines, layouts and outputs on small files: odd lines, many splits, runs that die, and features that are dealt out anew."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.anomaly import FEATURES, fit_forest, isolation
from ledgerlens.operators.importance import correlations, numbered, permutation_importance, permuted, pruned
from ledgerlens.operators.outputs import changes
from ledgerlens.plans.publish import latest, publish, published
from ledgerlens.sources.lines import kinds, numbered_lines, parse_columns, parse_report, parse_table, parse_text, parse_texts, parse_wrapped
from ledgerlens.sources.roles import cells_of, column_shares, data_cells, header_rows, normalised, roles_by_content, roles_by_name, roles_by_position

WRAPPED = """STATEMENT OF ACCOUNT
no date yet 5.00
01-02-2024 UPI first 100.00 1,100.00CR
Page 1
more words
02-02-2024 split row
REF 7 40.00 1,060.00 Cr
03-02-2024 no balance 5.00
04-02-2024 equal 3.00 1,060.00DR
***"""
REPORT = """Customer Account Ledger Report
B/F Balance : 500.00CR
GL. Date
01-02-2024  01-02-2024  77  UPI A  100.00  400.00Cr CDCI  V1
02-02-2024  02-02-2024  78  two sums  1.00  2.00  401.00Cr  U1  V1
02-02-2024  x  78  no second date  1.00  402.00Cr
03-02-2024  03-02-2024  79  up  9.00  410.00Cr
Page Total 3"""
TABLE = """TXN DATE VALUE DATE
a note of it
01-FEB-2024 02-FEB-2024 shop 5.00 0.00 95.00
lost note
PAGE 2
03-FEB-2024 03-FEB-2024 pay 0.00 6.00 101.00
12.00 a number first
04-FEB-2024 04-FEB-2024 fee 1.00 0.00 100.00"""
COLUMNS = """Gramin
01/02/2024  UPI A  10.00CR  90.00
02/02/2024\tcash\t5.00DR\t85.00
3/2/24 one two 7.00
04/02/2024 nothing"""
TEXT = """Account
Txn Date  Narration  Ref No  Debit  Credit  Balance
first words without date
01/02/2024  UPI A  U1  5.00  0.00  95.00
goes on here
02/02/2024  short
03/02/2024  UPI B  U2  0.00  9.00  104.00
Page 2 of 3"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("statements")
    for name, text in {"a/wrapped.txt": WRAPPED, "a/report.txt": REPORT, "b/table.txt": TABLE, "columns.txt": COLUMNS, "text.txt": TEXT, "none.txt": "nothing\nhere", "empty.txt": ""}.items():
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    (root / "long.txt").write_text("\n".join(f"line {k}" for k in range(5000)))
    return str(root)


def shown(rows):
    return [tuple(r)[2:] for r in rows.orderBy("line_no").collect()]


def test_lines_are_numbered_over_splits(spark, folder):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = numbered_lines(spark, folder)
        rows = lines.filter("source_file = 'long.txt'").orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.line_no, r.line) for r in rows] == [(k + 1, f"line {k}") for k in range(5000)]


def test_layouts(spark, folder):
    lines = numbered_lines(spark, folder)
    of = lambda name: lines.filter(F.col("source_file").endswith(name))
    assert shown(parse_wrapped(of("wrapped.txt"))) == [("01-02-2024", "UPI first more words", 0.0, 100.0, "1,100.00CR"), ("02-02-2024", "split row REF 7", 40.0, 0.0, "1,060.00 Cr"), ("04-02-2024", "equal", 0.0, 3.0, "1,060.00DR")]
    assert shown(parse_report(of("report.txt"))) == [("01-02-2024", "77 UPI A", 100.0, 0.0, "400.00Cr"), ("02-02-2024", "78 two sums", 1.0, 2.0, "401.00Cr"), ("03-02-2024", "79 up", 0.0, 9.0, "410.00Cr")]
    assert shown(parse_table(of("table.txt"))) == [("01-FEB-2024", "a note of it shop", "5.00", "0.00", "95.00"), ("03-FEB-2024", "pay", "0.00", "6.00", "101.00"), ("04-FEB-2024", "fee", "1.00", "0.00", "100.00")]
    assert shown(parse_columns(of("columns.txt"))) == [("01/02/2024", "UPI A", "", "10.00CR", "90.00"), ("02/02/2024", "cash", "5.00DR", "", "85.00")]
    text = parse_text(of("/text.txt")).orderBy("line_no").collect() or parse_text(of("text.txt")).orderBy("line_no").collect()
    assert [(r.date, r.narration, r.debit, r.balance) for r in text] == [("01/02/2024", "UPI A", "5.00", "95.00 goes on here"), ("03/02/2024", "UPI B", "0.00", "104.00")]
    assert {r.source_file: r.kind for r in kinds(lines).collect()} == {"a/wrapped.txt": "wrapped", "a/report.txt": "report", "b/table.txt": "table", "columns.txt": "columns", "text.txt": "text", "none.txt": None, "long.txt": None}
    assert collections.Counter(r.kind for r in parse_texts(lines).collect()) == {"wrapped": 3, "report": 3, "table": 3, "columns": 2, "text": 2}
    assert parse_texts(lines.limit(0)).count() == 0


def test_roles(spark):
    tables = {
        "plain": ["Value Dr|Txn Date|Remarks|Withdrawal|Deposit|Balance", *(f"0{k}/02/2024|0{k}/02/2024|shop {k}|{k}0.00||{900 - k}.50" for k in range(1, 8))],
        "late": ["01/02/2024|100.00|200.00|x", "||title|", "Tran Date|Narration|Amount|Dr/Cr type", *(f"0{k}-Mar-2024|pay {k}|{k},500.00|{'D' if k % 2 else 'C'}" for k in range(1, 8))],
        "bare": [f"{k}|2024-02-0{k}|words of row {k}|{k}1.00|9{k}.00" for k in range(1, 9)],
        "none": ["a|b", "|"],
    }
    lines = spark.createDataFrame([(f, k + 1, line) for f, rows in tables.items() for k, line in enumerate(rows)], "source_file string, line_no long, line string").repartition(3)
    cells = cells_of(lines)
    headers = header_rows(cells)
    assert {r.file: r.header_row for r in headers.collect()} == {"plain": 0, "late": 2, "bare": 0, "none": 0}
    shares = column_shares(data_cells(cells, headers))
    named = {r.file: r for r in roles_by_name(cells, headers, shares).collect()}
    # A column of dates is no debit, whatever its name says.
    assert (named["plain"].date, named["plain"].debit, named["plain"].credit, named["plain"].balance, named["plain"].narration) == (1, 3, 4, 5, 2)
    assert (named["late"].date, named["late"].narration, named["late"].amount, named["late"].debit) == (0, 1, 2, 3)
    by_content = {r.file: r for r in roles_by_content(roles_by_name(cells, headers, shares), shares).collect()}
    assert (by_content["bare"].date, by_content["bare"].amount, by_content["bare"].balance) == (1, 3, 4)  # the first column counts rows
    roles = roles_by_position(roles_by_content(roles_by_name(cells, headers, shares), shares), shares)
    placed = {r.file: r for r in roles.collect()}
    assert placed["bare"].narration == 2 and placed["none"].date is None
    rows = normalised(cells, headers, roles).filter("file = 'plain'").orderBy("row").collect()
    assert [(r.date, r.narration, r.debit, r.balance) for r in rows][:2] == [("01/02/2024", "shop 1", 10.0, 899.5), ("02/02/2024", "shop 2", 20.0, 898.5)]
    assert header_rows(cells.limit(0)).count() == 0


def test_outputs_appear_together(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    first = spark.range(100).select("id", (F.col("id") % 3).alias("part"))
    assert latest(spark, folder).count() == 0
    with pytest.raises(LookupError):
        published(spark, folder, "rows")
    publish(folder, {"rows": (first, ["part"]), "sums": (first.groupBy("part").count(), [])})
    publish(folder, {"rows": (first, ["part"]), "sums": (first.groupBy("part").count(), [])})
    assert published(spark, folder, "rows").count() == 100 and published(spark, folder, "sums").count() == 3
    # The second output of this run dies after the first was written: readers still see the state before.
    broken = first.select(F.when(F.col("id") == 99, F.raise_error(F.lit("killed"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        publish(folder, {"rows": (first.limit(5), ["part"]), "sums": (broken, [])})
    assert published(spark, folder, "rows").count() == 100
    publish(folder, {"rows": (first.limit(0), ["part"])})
    assert {(r.output, r.n_rows) for r in latest(spark, folder).collect()} == {("rows", 0)}


def test_changes(spark):
    rows = [(1, "a", None, None, "", ""), (2, "a", "1", None, " ", "10:00:00"), (3, "a", None, "2", "x", " "), (4, "a", "1", "2", "x", "10:00:00")]
    df = spark.createDataFrame(rows, "leg_id long, account_id string, d string, c string, narration_raw string, time_raw string").select("*", F.col("d").cast("decimal(18,2)").alias("debit_raw"), F.col("c").cast("decimal(18,2)").alias("credit_raw"))
    got = {(r.leg_id, r.field, r.old_value, r.new_value) for r in changes(df).collect()}
    assert got == {(1, "narration", "", None), (1, "time", "", "00:00:00"), (1, "debit, credit", None, None), (2, "narration", " ", None), (2, "credit", None, "0"), (3, "debit", None, "0"), (3, "time", " ", "00:00:00")}
    assert changes(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def features(spark):
    rng = random.Random(1)
    rows = [(k, "a", "d", float(rng.randrange(50)), 0.0, float(k % 24), 1.0, float(k % 2), rng.random(), float(rng.randrange(3))) for k in range(600)]
    rows = [(*r[:4], r[3] * 2, *r[5:]) for r in rows]
    return spark.createDataFrame(rows, "leg_id long, account_id string, date string, " + ", ".join(f"{c} double" for c in FEATURES)).repartition(5)


def test_shuffles_use_each_value_once(features):
    own = {r.leg_id: tuple(r[c] for c in FEATURES) for r in features.collect()}
    rows = permuted(features, FEATURES, 3).collect()
    assert {r.leg_id: tuple(r[c] for c in FEATURES) for r in rows} == own
    assert collections.Counter(tuple(r[f"_{c}"] for c in FEATURES) for r in rows) == collections.Counter(own.values())
    assert sum(tuple(r[f"_{c}"] for c in FEATURES) != own[r.leg_id] for r in rows) > 500
    assert [r.k for r in numbered(features, "leg_id").orderBy("leg_id").collect()] == list(range(600))


def test_importance(spark, features):
    forest = fit_forest(features, trees=20, per_tree=64)
    got = {r.feature: r.importance for r in permutation_importance(features, forest, repeats=2).collect()}
    moved = np.zeros(len(FEATURES))
    for seed in range(2):
        rows = permuted(features, FEATURES, seed).toPandas()
        x, other = rows[FEATURES].to_numpy(), rows[[f"_{c}" for c in FEATURES]].to_numpy()
        base = isolation(x, forest)
        for k in range(len(FEATURES)):
            y = x.copy()
            y[:, k] = other[:, k]
            moved[k] += np.abs(isolation(y, forest) - base).mean() / 2
    assert all(abs(got[c] - moved[k] / (moved.sum() + 1e-9)) < 1e-9 for k, c in enumerate(FEATURES))
    assert got["weekday"] == 0
    related = {(r.a, r.b): r.correlation for r in correlations(features).collect()}
    frame = features.toPandas()
    assert all((v is None) == (frame[a].std() * frame[b].std() == 0) and (v is None or abs(v - frame[a].corr(frame[b])) < 1e-9) for (a, b), v in related.items())
    kept = {r.feature: r.kept for r in pruned(spark.createDataFrame(list(got.items()), "feature string, importance double"), correlations(features), drop=2).collect()}
    ranked = sorted(got, key=lambda c: (-got[c], c))
    weaker = max(("amount", "log_amount"), key=ranked.index)
    assert kept == {c: c not in ranked[-2:] and not (c == weaker and not {"amount", "log_amount"} & set(ranked[-2:])) for c in got}
