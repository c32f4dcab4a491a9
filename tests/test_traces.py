"""Trails, taint, orders, cycles, centrality and communities against brute force on small ledgers, and on odd input."""

import collections
import datetime
import itertools
import random
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.betweenness import balls, betweenness, graph_metrics
from ledgerlens.operators.fifo import fifo_allocate
from ledgerlens.operators.graph import communities
from ledgerlens.operators.intraday import same_day_order
from ledgerlens.operators.modularity import modular_communities, modularity, symmetric
from ledgerlens.operators.short_cycles import short_cycles
from ledgerlens.operators.taint import attributions, both_orders, commingling, commingling_accounts, lifo_allocate, taint_hops, tracked_flow

LEDGER = "leg_id long, account_id string, cp string, debit decimal(18,2), credit decimal(18,2), ts timestamp, utr_ref string, narration string, channel string"
PAIRS = "src string, dst string, total decimal(18,2)"
START = datetime.datetime(2024, 1, 1)


def small_ledger(spark, n=300, accounts=9, seed=1):
    """Transfers among a few accounts, both legs, with many equal amounts and times; every sixth goes to an outside party."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        a, b = rng.sample(range(accounts), 2)
        amount, ts = Decimal(rng.choice([1, 5, 5, 20, 33])) + Decimal(rng.randrange(3)) / 100, START + datetime.timedelta(hours=rng.randrange(n // 2))
        outside = k % 6 == 0
        rows.append((2 * k, f"A{a}", "X" if outside else f"A{b}", amount, Decimal(0), ts, f"U{k}", f"PAY U{k}", "UPI"))
        if not outside:
            rows.append((2 * k + 1, f"A{b}", f"A{a}", Decimal(0), amount, ts, f"U{k}", f"PAY U{k}", "UPI"))
    return spark.createDataFrame(rows, LEDGER), rows


def stacks(rows, last):
    """(credit or None, debit) to the amount, by a queue or a stack a account."""
    out, open_ = collections.Counter(), collections.defaultdict(list)
    for leg, account, _, debit, credit, ts, *_ in sorted(rows, key=lambda r: (r[1], r[5], r[0])):
        held = open_[account]
        if credit:
            held.append([leg, credit])
        while debit and held:
            lot = held[-1 if last else 0]
            part = min(debit, lot[1])
            out[lot[0], leg] += part
            lot[1] -= part
            debit -= part
            if not lot[1]:
                held.remove(lot)
        if debit:
            out[None, leg] += debit
    return out


@pytest.mark.parametrize("last", [False, True])
def test_orders_of_spending(spark, last):
    ledger, rows = small_ledger(spark)
    got = collections.Counter()
    for r in (lifo_allocate if last else fifo_allocate)(ledger).collect():
        got[r.credit_id, r.debit_id] += r.allocated
    assert got == stacks(rows, last)
    assert (lifo_allocate if last else fifo_allocate)(ledger.limit(0)).count() == 0


def test_attributions_side_by_side(spark):
    ledger, rows = small_ledger(spark)
    seeds = ledger.filter("credit >= 20").select("leg_id")
    large, party = {r[0] for r in rows if r[4] >= 20}, {r[0]: r[2] for r in rows}
    account = {r[0]: r[1] for r in rows}
    want = collections.defaultdict(lambda: [0, 0])
    for last in (0, 1):
        for (credit, debit), amount in stacks(rows, last).items():
            if credit in large:
                want[account[debit], party[debit]][last] += amount
    got = {(r.account_id, r.destination): [r.amount_fifo, r.amount_lifo] for r in both_orders(attributions(ledger, seeds)).collect()}
    assert got == want and any(a != b for a, b in want.values())


def followed(rows, seeds, last, most):
    """The hops of taint_hops by recursion: (seed, way, from, to, tainted, clean, cycle)."""
    first = collections.Counter()
    for (credit, debit), amount in stacks(rows, last).items():
        if credit in seeds:
            first[debit] += amount
    of = {r[0]: r for r in rows}
    by_account = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        by_account[r[1]].append(r)
    out = []

    def go(seed, debit, part, way, path):
        if part <= Decimal("0.01"):
            return
        _, account, to, total, *_ = of[debit]
        way = (*way, debit)
        out.append((seed, way, account, to, part, total - part, to in path))
        if to in path or debit + 1 not in of or len(way) == most:
            return
        rest, arrival = part, (of[debit + 1][5], debit + 1)
        for r in by_account[to]:
            if r[3] and (r[5], r[0]) > arrival and rest:
                took = min(rest, r[3])
                rest -= took
                go(seed, r[0], took, way, (*path, to))

    for debit, amount in first.items():
        go(of[debit][1], debit, amount, (), ())
    return out


@pytest.mark.parametrize("method", ["fifo", "lifo"])
def test_taint(spark, method):
    ledger, rows = small_ledger(spark, n=120)
    hops = taint_hops(ledger, ledger.filter("credit >= 33").select("leg_id"), method, max_hops=4)
    got = sorted((r.seed_account, tuple(r.way), r.from_account, r.to_account, r.tainted, r.clean, r.is_cycle) for r in hops.collect())
    want = sorted(followed(rows, {r[0] for r in rows if r[4] >= 33}, method == "lifo", 4))
    assert got == want and any(r[-1] for r in want)
    ends = {tuple(r.way) for r in hops.filter("ends").collect()}
    assert ends == {w[1] for w in want} - {w[1][:-1] for w in want}
    assert taint_hops(ledger, ledger.limit(0).select("leg_id"), method).count() == 0


def test_commingled_shares_at_half_a_tenth(spark):
    """Shares halfway between two tenths are rounded as SQL rounds doubles, and a mean there doesn't depend on the order of rows."""
    parts = [("0.09", "20.00"), ("0.37", "20.00"), ("1.39", "20.00"), ("1.23", "20.00"), ("12.34", "56.78")]
    hops = spark.createDataFrame([("A", f"B{k}", START, Decimal(t), Decimal(n), Decimal(n) - Decimal(t), True, False) for k, (t, n) in enumerate(parts)], "from_account string, to_account string, ts timestamp, tainted decimal(28,2), total decimal(28,2), clean decimal(28,2), is_commingled boolean, is_cycle boolean")
    got = {r.forwarded_to: r.pct_tainted for r in commingling(hops).collect()}
    assert got == {f"B{k}": duckdb.execute(f"SELECT round(CAST({t} AS DOUBLE) / CAST({n} AS DOUBLE) * 100, 1)").fetchone()[0] for k, (t, n) in enumerate(parts)}
    orders = [[79.9, 85.0, 94.8, 97.2, 1.8, 8.6, 29.7, 91.4], [94.8, 8.6, 85.0, 79.9, 91.4, 97.2, 1.8, 29.7]]
    assert sorted(orders[0]) == sorted(orders[1]) and sum(Decimal(str(x)) for x in orders[0]) / 8 == Decimal("61.05")
    for order in orders:
        events = spark.createDataFrame([("A", Decimal(1), Decimal(2), x) for x in order], "account string, tainted_portion decimal(28,2), clean_portion decimal(28,2), pct_tainted double").coalesce(1)
        assert [tuple(r) for r in commingling_accounts(events).collect()] == [("A", 8, 8.0, 16.0, 61.1)]


def test_tracked_sums_are_conserved(spark):
    ledger, rows = small_ledger(spark, n=120)
    hops = tracked_flow(ledger, ledger.filter("credit > 0").select("leg_id"), 5).collect()
    spent, amount = collections.Counter(), {(): {r[0]: r[4] for r in rows}}
    for (credit, _), part in stacks(rows, False).items():
        spent[credit] += part
    by_way = {(r.seed_id, tuple(r.way)): r.amount for r in hops}
    onward = collections.Counter()
    for r in hops:
        onward[r.seed_id, tuple(r.way[:-1])] += r.amount
    for (seed, way), passed in onward.items():
        tracked = by_way[seed, way] if way else amount[()][seed]
        credit = way[-1] + 1 if way else seed
        assert passed == min(tracked, spent[credit])
    assert any(r.is_cycle for r in hops) and any(r.is_commingled for r in hops)
    assert all(r.left_over >= 0 for r in hops)


def chained(rows):
    """The same order by following links one by one."""
    out = {}
    days = collections.defaultdict(list)
    for leg, account, date, debit, credit, balance in sorted(rows):
        days[account, date].append((leg, balance, None if balance is None else balance - credit + debit))
    for day in days.values():
        after, used = {}, collections.Counter()
        gives = collections.defaultdict(list)
        for leg, balance, _ in day:
            gives[balance].append(leg)
        for leg, balance, prior in day:
            if balance is not None:
                k = used[prior]
                used[prior] += 1
                if k < len(gives[prior]) and gives[prior][k] != leg:
                    after[gives[prior][k]] = leg
        heads, seen = [x[0] for x in day if x[0] not in after.values()], set()
        chains = []
        for head in [*heads, *(x[0] for x in day)]:
            chain = []
            while head is not None and head not in seen:
                seen.add(head)
                chain.append(head)
                head = after.get(head)
            if chain:
                chains.append(chain)
        out.update({leg: k for k, leg in enumerate(itertools.chain.from_iterable(sorted(chains)))})
    return out


def test_same_day_order(spark):
    rng, rows, leg = random.Random(3), [], 0
    for account, day in itertools.product("ab", range(12)):
        balance, own = Decimal(rng.randrange(50)), []
        for _ in range(rng.choice([1, 2, 5, 9])):
            debit, credit = (Decimal(rng.randrange(0, 3)), Decimal(0)) if rng.random() < 0.5 else (Decimal(0), Decimal(rng.randrange(0, 3)))
            balance += credit - debit
            own.append((debit, credit, None if rng.random() < 0.1 else balance))
        rng.shuffle(own)
        for debit, credit, shown in own:
            rows.append((leg := leg + 1, account, f"d{day}", debit, credit, shown))
    rows += [(leg + 1, "r", "ring", Decimal(0), Decimal(1), Decimal(1)), (leg + 2, "r", "ring", Decimal(1), Decimal(0), Decimal(0)), (leg + 3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "leg_id long, account_id string, date string, debit decimal(18,2), credit decimal(18,2), balance decimal(28,2)")
    got = {r.leg_id: r.seq for r in same_day_order(df.filter("account_id is not null")).collect()}
    assert got == chained(rows[:-1])
    assert same_day_order(df.limit(0)).count() == 0


def random_pairs(rng, n, m):
    return sorted({(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)})


def test_short_cycles(spark):
    rng = random.Random(5)
    links = random_pairs(rng, 12, 40)
    out = collections.defaultdict(set)
    for a, b in links:
        out[a].add(b)
    want = set()

    def go(path):
        for b in out[path[-1]]:
            if b == path[0]:
                want.add(tuple(path))
            elif b > path[0] and b not in path and len(path) < 5:
                go([*path, b])

    for a in sorted(out):
        go([a])
    df = spark.createDataFrame([(a, b, Decimal(k + 1)) for k, (a, b) in enumerate(links)] + [(None, "n01", Decimal(1))], PAIRS)
    got = short_cycles(df, 5).collect()
    weight = {p: k + 1 for k, p in enumerate(links)}
    assert {tuple(r.nodes) for r in got} == want and len(got) == len(want)
    assert all(r.length == len(r.nodes) and r.flow == sum(weight[p] for p in zip(r.nodes, [*r.nodes[1:], r.nodes[0]])) for r in got)
    assert short_cycles(df.limit(0)).count() == 0


def brandes(links):
    out = collections.defaultdict(set)
    nodes = sorted({x for p in links for x in p})
    for a, b in links:
        if a != b:
            out[a].add(b)
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        order, sigma, dist, before, queue = [], collections.Counter({s: 1}), {s: 0}, collections.defaultdict(list), collections.deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    before[w].append(v)
        delta = collections.Counter()
        for w in reversed(order):
            for v in before[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


@pytest.mark.parametrize("growth", [1, 1000])
def test_betweenness(spark, growth):
    rng = random.Random(2)
    ring = [(f"r{k:02d}", f"r{(k + d) % 40:02d}") for k in range(40) for d in (1, 2)]
    links = [*ring, *random_pairs(rng, 15, 40), ("r03", "n01"), ("n02", "n02")]
    df = spark.createDataFrame([(a, b, Decimal(1)) for a, b in links], PAIRS)
    want = brandes(links)
    got = {r.id: r.betweenness for r in betweenness(df, growth=growth).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)
    assert (balls(df.filter("src <> dst"), growth)[1] > 1) == (growth > 1)
    assert betweenness(df.limit(0)).count() == 0 and betweenness(df.limit(1)).first().betweenness == 0
    metrics = graph_metrics(df, spark.createDataFrame([("r01",), ("r02",), ("nowhere",)], "account_id string")).collect()
    assert len(metrics) == 3 and max(r.graph_risk_score for r in metrics) == 1 and min(r.graph_risk_score for r in metrics) == 0


def test_modular_communities(spark):
    rng, rows = random.Random(8), []
    for part in range(6):
        inside = [f"p{part}-{k}" for k in range(12)]
        rows += [(a, b, Decimal(5)) for a, b in itertools.permutations(inside, 2) if rng.random() < 0.5]
        rows.append((inside[0], f"p{(part + 1) % 6}-3", Decimal(1)))
    df = spark.createDataFrame([*rows, (None, "p0-1", Decimal(1)), ("p0-0", "p0-0", Decimal(2))], PAIRS)
    labels = modular_communities(df)
    groups = collections.defaultdict(set)
    for r in labels.collect():
        groups[r.community].add(r.id.split("-")[0])
    assert sorted(map(len, groups.values())) == [1] * 6 and all(min(g) == c.split("-")[0] for c, g in groups.items())
    both = symmetric(df)
    assert modularity(both, labels) >= modularity(both, communities(df.dropna())) - 1e-9
    weight = collections.Counter()
    for a, b, w in [*rows, ("p0-0", "p0-0", Decimal(2))]:
        weight[a, b] += float(w)
        weight[b, a] += float(w)
    of = {r.id: r.community for r in labels.collect()}
    total, degree = sum(weight.values()), collections.Counter()
    for (a, _), w in weight.items():
        degree[of[a]] += w
    q = sum(w for (a, b), w in weight.items() if of[a] == of[b]) / total - sum(x * x for x in degree.values()) / total**2
    assert abs(modularity(both, labels) - q) < 1e-9
    assert modular_communities(df.limit(0)).count() == 0
    assert modular_communities(df.select("src", F.col("src").alias("dst"), "total").dropna()).groupBy("community").count().filter("count > 1").count() == 0
