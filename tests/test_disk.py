"""What operators write and shuffle stays small, and what they find stays the same."""

import os
import random
import time
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens import catalog
from ledgerlens.operators.beam import beam_trails
from ledgerlens.operators.clean import as_copies, copied, raw
from ledgerlens.operators.inferred import told
from ledgerlens.operators.outputs import clean
from ledgerlens.operators.paths import cycles
from ledgerlens.operators.relations import common_times
from ledgerlens.operators.scores import PATTERNS, pattern_counts
from ledgerlens.operators.taint import taint_hops
from ledgerlens.plans import iterate
from ledgerlens.plans.fixpoint import checkpointed, fixpoint, shared_folder
from ledgerlens.sources.files import parse_delimited
from ledgerlens.sources.ledger_view import balanced, balanced_legs, legs

EDGES = "src string, dst string, amt decimal(18,2), t long, rid long"
HOUR = 3600


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f for f in files if "shuffle_" in os.path.basename(f)}


def rounds(spark):
    return {f for f in os.listdir(shared_folder(spark).removeprefix("file:")) if f.startswith("round-")}


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    table = checkpointed(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    assert table.agg(F.sum("n")).first()[0] == 1000 and table.filter("n = 143").count() == 6
    assert not {f for f in shuffle_files(spark) - before if os.path.getsize(f) > 20000}
    checkpointed(spark.range(200000).repartition(8, "id"))
    assert not {f for f in shuffle_files(spark) - before if os.path.getsize(f) > 20000}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") in ("false", None)


def test_fixpoint_keeps_one_round(spark):
    before = rounds(spark)
    start = spark.range(5).select("id", F.lit(0).alias("n"), F.lit(True).alias("changed"))
    got = fixpoint(start, lambda s: s.select("id", (F.col("n") + 1).alias("n"), (F.col("n") < 3).alias("changed")), "changed")
    assert {r.n for r in got.collect()} == {4} and len(rounds(spark) - before) == 1


def closed_walks(rows):
    """Brute force of cycles(): (cycle, seed, closing amount, seed amount) of every rotation's first."""
    sums = {}
    for r in rows:
        sums.setdefault(r[0], []).append(float(r[2]))

    def floor(xs):
        if len(xs) < 5:
            return 0.0
        xs, at = sorted(xs), 0.2 * (len(xs) - 1)
        return xs[int(at)] + (at - int(at)) * (xs[min(int(at) + 1, len(xs) - 1)] - xs[int(at)])

    floors = {k: floor(v) for k, v in sums.items()}
    usable = [r for r in rows if float(r[2]) >= floors[r[0]]]
    follows = lambda a, b: a[3] < b[3] <= a[3] + 96 * HOUR and b[2] >= a[2] * Decimal("0.55")
    best, ways = {}, [([r[0], r[1]], [r]) for r in usable]
    while ways:
        longer = []
        for nodes, path in ways:
            for e in usable:
                if e[0] != nodes[-1] or not follows(path[-1], e):
                    continue
                seed = path[0]
                if e[1] == nodes[0] and len(path) >= 2 and Decimal("0.55") * seed[2] <= e[2] <= Decimal("1.45") * seed[2] and (e[3] - seed[3]) // 86400 <= 45:
                    at = nodes.index(min(nodes))
                    key, rank = ">".join(nodes[at:] + nodes[:at]), (seed[3], [p[4] for p in path] + [e[4]])
                    if key not in best or rank < best[key][0]:
                        best[key] = (rank, nodes[0], float(seed[2]), float(e[2]), len(nodes))
                if e[1] not in nodes and len(path) < 5:
                    longer.append((nodes + [e[1]], path + [e]))
        ways = longer
    return {(k, *v[1:]) for k, v in best.items()}


def test_cycles_meet_in_the_middle(spark, monkeypatch):
    draw, longest = random.Random(4), []
    plain = iterate.iterate_paths

    def seen(edges, most, *a, **b):
        longest.append(most)
        return plain(edges, most, *a, **b)

    monkeypatch.setattr("ledgerlens.operators.paths.iterate_paths", seen)
    rows = [(draw.choice("abcdef"), draw.choice("abcdef"), Decimal(draw.randint(70, 130)), draw.randint(0, 900) * HOUR, k) for k in range(160)]
    got = {(r.cycle, r.seed_account, r.seed_amount, r.closing_amount, r.hop_count) for r in cycles(spark.createDataFrame(rows, EDGES)).collect()}
    want = closed_walks(rows)
    assert got == want and {x[4] for x in want} >= {3, 4, 5} and any(len(set(x[0].split(">"))) < x[4] for x in want)
    assert longest == [3]


LEG = "leg_id long, account_id string, cp string, debit decimal(18,2), credit decimal(18,2), ts timestamp, utr_ref string"


def small_ledger(spark, n=120, seed=9):
    draw, rows = random.Random(seed), []
    for k in range(n):
        a, b = draw.sample("abcdefg", 2)
        amount, at = Decimal(draw.randint(20, 90)), datetime(2024, 1, 1) + timedelta(minutes=draw.randint(0, 9000))
        rows += [(2 * k, a, b, amount, Decimal(0), at, f"U{k}"), (2 * k + 1, b, a, Decimal(0), amount, at, f"U{k}")]
    return rows, spark.createDataFrame(rows, LEG)


def test_taint_keeps_one_table_a_hop(spark):
    rows, ledger = small_ledger(spark, 60)
    seeds = ledger.filter("credit >= 80").select("leg_id")
    before = rounds(spark)
    hops = taint_hops(ledger, seeds, max_hops=4)
    new = [set(spark.read.parquet(f"{shared_folder(spark)}/{r}").columns) for r in rounds(spark) - before]
    assert sum("ends" in c for c in new) == 3 and sum("path" in c for c in new) == 1 and not any("part" in c and "id" in c for c in new)
    short = taint_hops(ledger, seeds, max_hops=4, ways=False)
    assert "way" not in short.columns and hops.count() == short.count() > 50
    assert sorted(map(str, hops.drop("way").collect())) == sorted(map(str, short.collect()))


def test_common_times_ask_with_a_semi_join(spark):
    rows, ledger = small_ledger(spark)
    pairs = spark.createDataFrame([(a, b) for a in "abcdefgx" for b in "abcdefgy" if a < b], "a string, b string")
    got = common_times(ledger, pairs)
    own = {a: [r for r in rows if r[1] == a] for a in "abcdefg"}
    near = {(a, b): sum(any(abs(r[5] - s[5]) <= timedelta(hours=2) for s in own.get(b, [])) for r in own.get(a, [])) for a, b in pairs.collect()}
    assert {(r.a, r.b): r.cooccurrence for r in got.collect()} == {p: round(n / len(own[p[0]]), 6) for p, n in near.items() if n}
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


def test_patterns_are_counted_and_written_one_by_one(spark):
    before = rounds(spark)
    pattern_counts(balanced_legs(spark, "/root/testdata/sf0.001")).count()
    new = [spark.read.parquet(f"{shared_folder(spark)}/{r}") for r in rounds(spark) - before]
    assert [t.select("account_id").distinct().count() == t.count() for t in new if "pattern" in t.columns] == [True] * (len(PATTERNS) + 1)


def test_balances_are_written_without_texts(spark):
    sf, before = "/root/testdata/sf0.001", rounds(spark)
    rows, plain = balanced_legs(spark, sf), balanced(legs(spark, sf))
    assert rows.schema == plain.schema and rows.exceptAll(plain).isEmpty() and plain.exceptAll(rows).isEmpty()
    (new,) = rounds(spark) - before
    assert not {"narration", "utr_ref", "leg_id"} & set(spark.read.parquet(f"{shared_folder(spark)}/{new}").columns)


def test_a_long_file_is_parsed_in_proportion_to_its_lines(spark):
    head = "A bank\n\nTxn Date,Particulars,Ref No.,Debit,Credit\n"
    body = "".join(f'2024-01-01,"a ""x"", {k}",U{k},1.00,0.00\n' for k in range(8000))
    texts = spark.createDataFrame([("a.csv", head + body + "cut off"), ("b.csv", "date debit credit\n1\n2"), ("c.csv", None)], "source_file string, content string")
    began = time.time()
    rows = parse_delimited(texts).collect()
    assert time.time() - began < 30 and len(rows) == 8000 and {r.source_file for r in rows} == {"a.csv"}
    assert (rows[7].narration, rows[7].utr_ref, rows[7].line_no) == ('a "x", 7', "U7", 10)


def test_trails_join_by_short_ids(spark):
    rows, ledger = small_ledger(spark)
    before = rounds(spark)
    trails = beam_trails(ledger.withColumn("narration", F.col("utr_ref")))
    plan = trails._jdf.queryExecution().optimizedPlan().toString()
    assert trails.count() > 7 and "Join" not in plan and len(rounds(spark) - before) == 1 + 8 + 1


def test_written_texts_are_deleted_once_read(spark):
    held = lambda: {f for f in os.listdir(shared_folder(spark).removeprefix("file:")) if f.startswith("printed-")}
    before = held()
    cells, headers, shares = told(spark, "/root/testdata/sf0.001")
    assert cells.count() > 6 * 11000 and headers.count() == shares.select("file").distinct().count() == 40
    assert catalog.QUERIES["snk_ingest"](spark, "/root/testdata/sf0.001").count() == 2
    assert held() == before


def test_copies_are_written_without_texts(spark):
    sf, before = "/root/testdata/sf0.001", rounds(spark)
    folder = f"{shared_folder(spark)}/outputs-test"
    clean(folder, raw(spark, sf), as_copies(checkpointed(copied(spark, sf))), balanced_legs(spark, sf))
    new = [spark.read.parquet(f"{shared_folder(spark)}/{r}").columns for r in rounds(spark) - before]
    assert len(new) == 2 and not any("narration" in c for c in new)
