"""Queries do their whole job: against brute force over every row of the smallest ledger."""

from collections import Counter, defaultdict

import pytest

from ledgerlens import catalog, operators  # noqa: F401
from ledgerlens.operators.graph import with_outside
from ledgerlens.sources.ledger_view import legs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ledger(spark):
    return sorted(legs(spark, SF).collect(), key=lambda r: (r.account_id, r.ts, r.leg_id))


@pytest.fixture(scope="module")
def edges(spark):
    rows = with_outside(legs(spark, SF)).collect()
    own = {r.account_id for r in rows}
    return [(r.account_id, r.cp) for r in rows if r.debit > 0] + [(r.cp, r.account_id) for r in rows if r.credit > 0 and r.cp not in own]


def smallest_of_component(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        up[high] = low
    return {x: top(x) for x in up}


def test_components_of_all_edges(spark, edges):
    want = smallest_of_component(edges)
    assert {r.account_id: r.component for r in catalog.QUERIES["gr_wcc"](spark, SF).collect()} == want
    n, pairs = len(want), len(set(edges))
    got = catalog.QUERIES["ag_graph_summary"](spark, SF).first().asDict()
    own = {r.account_id for r in legs(spark, SF).select("account_id").distinct().collect()}
    inside = len(own & set(want))
    assert inside < n and got == {"nodes": n, "internal": inside, "external": n - inside, "components": len(set(want.values())), "edges": pairs, "transactions": len(edges), "density": round(pairs / (n * (n - 1)), 8)}


def test_suppression_takes_the_detectors_rows(spark):
    flagged = {r.leg_id for q in ("wn_velocity",) for r in catalog.QUERIES[q](spark, SF).select("leg_id").collect()}
    from ledgerlens.operators.windows import iqr_outliers

    flagged |= {r.leg_id for r in iqr_outliers(legs(spark, SF)).collect()}
    got = Counter(r.leg_id for r in catalog.QUERIES["ml_suppress"](spark, SF).collect())
    assert flagged and got == Counter(flagged)


def test_pages_hold_all_rows_of_all_accounts(spark, ledger):
    got = catalog.QUERIES["sv_account_txns"](spark, SF).collect()
    of = defaultdict(list)
    for r in ledger:
        of[r.account_id].append((r.date, r.time, r.leg_id))
    want = {(a, k // 100 + 1, len(rows), leg) for a, rows in of.items() for k, (_, _, leg) in enumerate(sorted(rows))}
    assert len(got) == len(ledger) and {(r.account_id, r.page, r.total, r.leg_id) for r in got} == want


def test_credits_are_followed_until_used_up(spark, ledger):
    of = defaultdict(list)
    for r in ledger:
        of[r.account_id].append(r)
    want = {}
    for rows in of.values():
        for i, c in enumerate(rows):
            left = c.credit
            for d in rows[i + 1 :] if left > 0 else []:
                if d.debit > 0:
                    want[c.leg_id, d.leg_id] = float(min(left, d.debit))
                    left -= d.debit
                    if left <= 0:
                        break
    got = catalog.QUERIES["tr_fifo_fwd"](spark, SF).collect()
    assert len(got) == len(want) and {(r.credit_id, r.debit_id): r.traced for r in got} == want
