"""Planted patterns and near misses, and properties that must hold."""

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.functions.money import with_amount
from ledgerlens.operators.fifo import fifo_allocate
from ledgerlens.operators.graph import components, pagerank
from ledgerlens.operators.paths import cycles, layering
from ledgerlens.operators.risk import risk_tier
from ledgerlens.operators.windows import fan, velocity
from ledgerlens.sources.ledger_view import legs

START = datetime(2024, 1, 1, 10)
COLUMNS = "leg_id long, rid long, account_id string, cp string, debit decimal(18,2), credit decimal(18,2), ts timestamp, date string, time string, channel string, utr_ref string, narration string, source_file string"


def leg(i, account, cp, debit=0, credit=0, hours=0.0):
    ts = START + timedelta(hours=hours)
    return (i, i, account, cp, Decimal(debit), Decimal(credit), ts, ts.strftime("%Y-%m-%d"), ts.strftime("%H:%M:%S"), "UPI", f"U{i}", "x", "F0")


def test_fan_in_and_its_near_miss(spark):
    senders = [leg(k, "hit", f"s{k}", credit=100, hours=24 * k) for k in range(4)]
    late = [leg(10 + k, "miss", f"s{k}", credit=100, hours=24 * k + (0.001 if k == 3 else 0)) for k in range(4)]
    found = fan(spark.createDataFrame(senders + late, COLUMNS), "in").collect()
    assert [(r.account_id, r.n_parties) for r in found] == [("hit", 4)]


def test_velocity_is_half_an_hour(spark):
    rows = [leg(1, "a", "x", 1), leg(2, "a", "x", 1, hours=0.25), leg(3, "a", "x", 1, hours=0.5)]
    rows += [leg(4, "b", "x", 1), leg(5, "b", "x", 1, hours=0.25), leg(6, "b", "x", 1, hours=0.5003)]
    found = velocity(spark.createDataFrame(rows, COLUMNS)).filter("is_velocity_flag").collect()
    assert {r.leg_id for r in found} == {1, 2, 3}


def test_fifo_worked_example(spark):
    rows = [leg(1, "a", "x", credit=100), leg(2, "a", "x", 60, hours=1), leg(3, "a", "x", credit=50, hours=2), leg(4, "a", "x", 120, hours=3)]
    got = {(r.credit_id, r.debit_id): float(r.allocated) for r in fifo_allocate(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {(1, 2): 60.0, (1, 4): 40.0, (3, 4): 50.0, (None, 4): 30.0}


def test_fifo_conserves_debits_and_credits(spark):
    ledger = legs(spark, "/root/testdata/sf0.001")
    a = fifo_allocate(ledger)
    debits = a.groupBy("debit_id").agg(F.sum("allocated").alias("paid")).join(ledger, F.col("debit_id") == F.col("leg_id"))
    assert debits.filter("paid <> debit").count() == 0
    credits = a.filter("credit_id is not null").groupBy("credit_id").agg(F.sum("allocated").alias("used")).join(ledger, F.col("credit_id") == F.col("leg_id"))
    assert credits.filter("used > credit").count() == 0


EDGES = "src string, dst string, amt decimal(18,2), t long, rid long"


def test_cycle_and_layering(spark):
    h = 3600
    ring = [("A", "B", Decimal(100), 0, 1), ("B", "C", Decimal(90), 40 * h, 2), ("C", "A", Decimal(81), 80 * h, 3)]
    assert [r.cycle for r in cycles(spark.createDataFrame(ring, EDGES)).collect()] == ["A>B>C"]
    slow = [ring[0], ring[1], ("C", "A", Decimal(81), 40 * h + 97 * h, 3)]
    assert cycles(spark.createDataFrame(slow, EDGES)).count() == 0
    chain = [("A", "B", Decimal(100), 0, 1), ("B", "C", Decimal(100), 72 * h, 2), ("C", "D", Decimal(100), 144 * h, 3)]
    assert layering(spark.createDataFrame(chain, EDGES)).count() == 1
    late = [chain[0], chain[1], ("C", "D", Decimal(100), 144 * h + 1, 3)]
    assert layering(spark.createDataFrame(late, EDGES)).count() == 0


def test_components_and_ranks(spark):
    pairs = spark.createDataFrame([(str(k).zfill(3), str(k + 1).zfill(3), 1.0) for k in range(40)] + [("x", "y", 1.0)], "src string, dst string, total double")
    assert {r.component for r in components(pairs).collect()} == {"000", "x"}
    total = pagerank(pairs, rounds=5).agg(F.sum("pagerank")).first()[0]
    assert abs(total - 1) < 1e-9


def test_amounts(spark):
    cases = {"(500)": -500.0, "₹20,000": 20000.0, "2.5 Lakh": 250000.0, "1 crore": 10000000.0, "1,234.56CR": 1234.56, "99DR": -99.0, "-": 0.0, "Nil": 0.0, None: 0.0, "1.2.3": 1.23}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string")
    assert {r.raw: r.amount for r in with_amount(rows, "raw", "amount").collect()} == cases


def test_tiers(spark):
    rows = spark.createDataFrame([(80.0, True), (55.0, True), (30.0, True), (10.0, True), (32.6, False), (45.0, False), (24.9, False)], "score double, seen boolean")
    got = [r[0] for r in rows.select(risk_tier(F.col("score"), F.col("seen"))).collect()]
    assert got == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "HIGH", "CRITICAL", "LOW"]
