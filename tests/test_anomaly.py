"""The isolation forest, strongly connected parts and parties against plain computations."""

import numpy as np
import pytest

from ledgerlens import catalog, operators  # noqa: F401
from ledgerlens.operators.anomaly import FEATURES, Forest, fit_forest, grow, isolation, mean_path, predict, scaler, score, threshold
from ledgerlens.operators.parties import party_account, party_name
from ledgerlens.operators.risk import community_risk
from ledgerlens.operators.strong import strongly_connected


def parts_by_reach(edges):
    nodes = {x for e in edges for x in e}
    after = {x: {b for a, b in edges if a == x} for x in nodes}

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            for y in after[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    far = {x: reach(x) for x in nodes}
    return {x: min(y for y in far[x] if x in far[y]) for x in nodes}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strongly_connected_parts(spark, seed):
    rng = np.random.default_rng(seed)
    edges = {(f"n{a:02d}", f"n{b:02d}") for a, b in rng.integers(0, 24, (28, 2))}
    edges |= {("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("d", "x"), ("x", "y"), ("y", "x"), ("s", "s")}
    rows = [*edges, ("a", "b"), (None, "a")]
    got = {r.id: r for r in strongly_connected(spark.createDataFrame(rows, "src string, dst string")).collect()}
    want = parts_by_reach(edges)
    assert {x: r.scc for x, r in got.items()} == want
    assert all(r.members == sum(v == r.scc for v in want.values()) for r in got.values())


def test_strongly_connected_without_rows(spark):
    assert strongly_connected(spark.createDataFrame([], "src string, dst string")).collect() == []


def rows_of(spark, n, far=()):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, len(FEATURES)))
    for k in far:
        x[k] = 40.0 + k
    return x, spark.createDataFrame([(k, "A", *map(float, r)) for k, r in enumerate(x)], f"leg_id long, account_id string, {', '.join(f'{c} double' for c in FEATURES)}")


def walked(row, forest, start):
    at = start
    while forest.left[at] != at:
        at = forest.left[at] + int(row[forest.feature[at]] > forest.cut[at])
    return forest.length[at]


def test_forest_scores(spark):
    x, rows = rows_of(spark, 1500, far=(7, 700, 1400))
    forest = fit_forest(rows, trees=40, per_tree=128, seed=5)
    got = {r.leg_id: r.raw for r in score(rows, forest).collect()}
    scaled = (x - forest.center) / forest.scale
    for k in (0, 7, 99, 700, 1400):
        mean = np.mean([walked(scaled[k], forest, s) for s in forest.starts])
        assert got[k] == pytest.approx(2 ** (-mean / mean_path(128)), abs=1e-6)
    assert {k for k, _ in sorted(got.items(), key=lambda kv: -kv[1])[:3]} == {7, 700, 1400}
    again = {r.leg_id: r.raw for r in score(rows, fit_forest(rows, trees=40, per_tree=128, seed=5)).collect()}
    assert again == got
    bounds = threshold(score(rows, forest), 0.05)
    assert bounds.first().threshold == pytest.approx(np.percentile(list(got.values()), 95), abs=1e-9)
    told = predict(score(rows, forest), bounds).collect()
    assert sum(r.is_flagged for r in told) == 75
    assert {r.risk_tier for r in told if r.leg_id in (7, 700, 1400)} == {"Critical"}


def test_scaler_is_exact_on_few_rows(spark):
    x, rows = rows_of(spark, 101)
    got = {r.feature: (r.center, r.scale) for r in scaler(rows.withColumn("hour", F_lit(3.0))).collect()}
    assert got["hour"] == (3.0, 1.0)
    assert got["amount"][0] == pytest.approx(np.median(x[:, 0]))
    assert got["amount"][1] == pytest.approx(np.subtract(*np.percentile(x[:, 0], [75, 25])))


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_forest_of_equal_rows_and_of_none(spark):
    feature, cut, left, length, starts = grow(np.ones((5, 2)), 3, 5, 0)
    flat = Forest(np.zeros(2), np.ones(2), *map(np.array, (feature, cut, left, length, starts)), 3, 5)
    assert isolation(np.ones((4, 2)), flat).tolist() == pytest.approx([0.5] * 4)
    with pytest.raises(ValueError):
        fit_forest(rows_of(spark, 1)[1].limit(0))


def test_parties(spark):
    told = {
        "UPI/123456/CR/RAM KUMAR/SBI": ("Ram Kumar", ""),
        "UPI/1/DR/ABCDEFGHIJ/x": ("Abcdefghij", ""),
        "IMPS/P2A/9876/asha devi/note": ("Asha Devi", ""),
        "paid to Joe.X@okaxis today": ("Joe.X@okaxis", "joe.x@okaxis"),
        "CHQ/0012345678901/rent o'hara": ("Rent O'Hara", "0012345678901"),
        "CASH": ("", ""),
        "": ("", ""),
        None: ("", ""),
    }
    # a code of eight or more capitals is no UPI name, nor a plausible part
    told["UPI/1/DR/ABCDEFGHIJ/x"] = ("", "")
    rows = spark.createDataFrame([(t,) for t in told], "t string")
    from pyspark.sql import functions as F

    assert {r.t: (r.n, r.a) for r in rows.select("t", party_name(F.col("t")).alias("n"), party_account(F.col("t")).alias("a")).collect()} == told


def test_community_risk(spark):
    labels = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("x", "x")], "id string, community string")
    scores = spark.createDataFrame([("a", 10.0), ("b", 25.5), ("c", 7.0), ("z", 99.0)], "account_id string, risk_score double")
    got = {tuple(r) for r in community_risk(labels, scores).select("community", "n_accounts", "avg_risk", "max_risk").collect()}
    assert got == {("a", 2, 17.75, 25.5), ("c", 1, 7.0, 7.0)}
    assert community_risk(labels, scores.limit(0)).collect() == []
