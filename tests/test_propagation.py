"""Spread risk, growing views, and two layouts of statements against plain computations."""

import random

import pytest

from ledgerlens.operators.propagation import grown_view, propagated
from ledgerlens.sources.lines import kinds, numbered_lines, parse_dated, parse_listed, parse_texts

RELATIONS = "account_a string, account_b string, relationship_score double"
RISKS = "account_id string, risk_score double"


def spread(relations, risks):
    nodes = sorted(risks)
    near = {x: {} for x in nodes}
    for a, b, w in relations:
        if w >= 5 and a in near and b in near:
            near[a][b] = near[b][a] = w
    total = sum(risks.values())
    start = {x: risks[x] / total if total else 1 / len(nodes) for x in nodes}
    rank = dict(start)
    for _ in range(300):
        lost = sum(rank[x] for x in nodes if not near[x])
        rank = {x: 0.15 * start[x] + 0.85 * (lost * start[x] + sum(rank[y] * w / sum(near[y].values()) for y, w in near[x].items())) for x in nodes}
    top = max(rank.values())
    return {x: 0.6 * risks[x] + 40 * rank[x] / top for x in nodes}, rank


@pytest.mark.parametrize("silent", [False, True])
def test_spread_risk(spark, silent):
    rng = random.Random(3)
    risks = {f"a{k}": 0.0 if silent else float(rng.choice([0, 10, 35, 80])) for k in range(9)} | {"alone": 0.0 if silent else 50.0}
    relations = [(f"a{a}", f"a{b}", rng.choice([3.0, 5.0, 20.0, 60.0])) for a in range(9) for b in range(a + 1, 9) if rng.random() < 0.4] + [("a0", "nobody", 90.0)]
    got = {r.account_id: r for r in propagated(spark.createDataFrame(relations, RELATIONS), spark.createDataFrame([*risks.items(), (None, 3.0)], RISKS)).collect()}
    want, rank = spread(relations, risks)
    assert got.keys() == want.keys()
    for x, r in got.items():
        assert r.pagerank == pytest.approx(rank[x], abs=1e-6)
        assert r.propagated_risk == pytest.approx(want[x], abs=0.0501)
        assert r.risk_elevation == pytest.approx(r.propagated_risk - risks[x], abs=1e-9)


def test_no_relationships(spark):
    got = propagated(spark.createDataFrame([("a", "b", 4.9)], RELATIONS), spark.createDataFrame([("a", 10.0), ("b", None)], RISKS)).collect()
    assert sorted((r.account_id, r.propagated_risk, r.risk_elevation) for r in got) == [("a", 10.0, 0.0), ("b", 0.0, 0.0)]
    assert propagated(spark.createDataFrame([], RELATIONS), spark.createDataFrame([], RISKS)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_growing_views(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(30)] + [("n0", "n1")]
    count = {f"n{k}": rng.choice([10, 30, 31, 90]) for k in range(25)}
    seeds = ["n0", "n7", "n7", "nowhere"]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    hop = {s: 0 for s in seeds if s in near}
    opened, frontier = set(), list(hop)
    for k in range(3):
        after = []
        for x in frontier:
            if k == 0 or count[x] > 30:
                opened.add(x)
                for y in near[x] - hop.keys():
                    hop[y] = k + 1
                    after.append(y)
        frontier = after
    pairs = spark.createDataFrame(edges, "src string, dst string")
    got = {r.id: r for r in grown_view(pairs, spark.createDataFrame([(s,) for s in seeds], "id string"), spark.createDataFrame(list(count.items()), "id string, n long")).collect()}
    assert {x: r.hop for x, r in got.items()} == hop
    assert {x for x, r in got.items() if r.expanded} == opened


LISTED = """A BANK
01-02-2024 above the header 1.00 2.00
-----
DATE  PARTICULARS  WITHDRAWAL  DEPOSIT  BALANCE
a note
01-02-2024 shop 5.00 0.00 1,095.00Cr
lost words
01-02 broken
02-02-24 fee 1.00 94.00Dr
TOTAL 6.00
IFSC of the bank
kept words
03-02-2024 pay 0.00 6.00 100.00"""
DATED = """Bank of somewhere
Date Particulars Debit Credit Balance
B/F 500.00(Cr)
01/02/24 UPI A 100.00
400.00 Cr
. . wrapped words .
02/02/2024U77 cash . 50.00 450.00(Cr)
03/02/2024 03/02/2024 two signs 7.00Dr 7.00Dr 443.00 (Cr)
04/02/2024 no amounts
05/02/2024 plain 1.00 2.00 445.00
05/02/2024 one amount only 9.00
Page 2
Total 9.00 8.00
06/02/2024 same - 3.00 445.00"""
BARE = """06/02/2024 starts at once 3.00 20.00DR
07/02/2024 up 5.00 15.00"""


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("layouts")
    for name, text in (("listed", LISTED), ("dated", DATED), ("bare", BARE), ("empty", "")):
        (root / f"{name}.txt").write_text(text)
    return numbered_lines(spark, str(root))


def rows(df, columns):
    return [tuple(r[c] for c in columns) for r in sorted(df.collect(), key=lambda r: r.line_no)]


def test_listed(lines):
    got = rows(parse_listed(lines.filter("source_file = 'listed.txt'")), ["date", "narration", "debit", "credit", "balance"])
    assert got == [("01-02-2024", "a note shop", "5.00", "0.00", "1,095.00"), ("02-02-24", "fee", "", "", "94.00"), ("03-02-2024", "kept words pay", "0.00", "6.00", "100.00")]
    assert parse_listed(lines.filter("source_file = 'empty.txt'")).collect() == []


def test_dated(lines):
    columns = ["date", "narration", "debit", "credit", "balance", "utr_ref"]
    assert rows(parse_dated(lines.filter("source_file = 'dated.txt'")), columns) == [
        ("01/02/24", "UPI A", 100.0, 0.0, "400.00 Cr", ""),
        ("02/02/2024", "cash", 0.0, 50.0, "450.00(Cr)", "U77"),
        ("03/02/2024", "two signs", 7.0, 0.0, "443.00(Cr)", ""),
        ("05/02/2024", "plain", 0.0, 2.0, "445.00", ""),
        ("06/02/2024", "same", 0.0, 3.0, "445.00", ""),
    ]
    assert rows(parse_dated(lines.filter("source_file = 'bare.txt'")), columns) == [("06/02/2024", "starts at once", 3.0, 0.0, "20.00DR", ""), ("07/02/2024", "up", 5.0, 0.0, "15.00", "")]


def test_each_file_has_one_kind(lines):
    got = {r.source_file: r.kind for r in kinds(lines).collect()}
    assert got["listed.txt"] == "listed" and got["dated.txt"] == "dated"
    parsed = parse_texts(lines).groupBy("source_file").count().collect()
    assert {r.source_file: r["count"] for r in parsed if r.source_file != "bare.txt"} == {"listed.txt": 3, "dated.txt": 5}
