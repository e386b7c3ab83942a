"""Loops under the operator's own limits, held against brute force."""

from collections import defaultdict

import pytest

import __spark_entry__ as entry_module
from weftline import standins

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rings(spark):
    """All simple cycles of 2 to 6 accounts on debits of at least 10 000: {accounts: flow}, smallest account first."""
    edges = defaultdict(lambda: defaultdict(float))
    for r in standins.bank(spark, SF).where("debit >= 10000 and account_no <> receiver_account").collect():
        edges[r.account_no][r.receiver_account] += r.debit
    found = {}

    def walk(path, flow):
        for nxt, amount in edges.get(path[-1], {}).items():
            if nxt == path[0] and len(path) > 1:
                found[" > ".join(path)] = flow + amount
            elif nxt > path[0] and nxt not in path and len(path) < 6:
                walk([*path, nxt], flow + amount)

    for start in sorted(edges):
        walk([start], 0.0)
    return found


def test_loops_of_small_payments_and_six_accounts_count(spark, rings):
    queries = entry_module.queries()
    assert max(k.count(">") + 1 for k in rings) > 4 and 0 < len(rings) <= 50
    got = {r["accounts"]: r["total_flow"] for r in queries["g6_circular_flows_every_loop"](spark, SF).collect()}
    assert got == {k: round(v, 2) for k, v in rings.items()}
    roll = queries["a32_circular_rollup_every_loop"](spark, SF).first()
    assert (roll["loop_count"], round(roll["total_flow"], 2), roll["longest"]) == (len(rings), round(sum(rings.values()), 2), max(k.count(">") + 1 for k in rings))
    typology = {r["typology"]: r["count"] for r in queries["a17_typologies_every_loop"](spark, SF).collect()}
    assert typology["loops"] == len(rings)
