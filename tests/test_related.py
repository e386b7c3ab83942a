"""Links among selected payments and related payments: right rows, and no pair or candidate shuffled."""

import random
from collections import defaultdict

from weftline.operators.links import related_payments, relationship_links

SCHEMA = "txn_id string, account_no string, receiver_account string, sender_phone string, ts long, date string, counterparty_name string, debit double, credit double"


def _rows(n, ids, seed):
    rnd = random.Random(seed)
    pick = lambda name, k: rnd.choice([None, *[f"{name}{i}" for i in range(k)]])
    return [(f"t{i % ids:03d}", pick("a", 4), pick("a", 5), pick("p", 4), rnd.choice([None, *range(0, 20000, 400)]), f"d{rnd.randrange(3)}", pick("c", 3), float(i), None)
            for i in range(n)]


def test_links_of_unique_and_repeated_ids(spark):
    rows = _rows(60, 52, 4)
    want = defaultdict(list)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            pair = min(a[0], b[0]), max(a[0], b[0])
            if a[0] == b[0]:
                continue
            if a[2] == b[1] is not None:
                want[pair].append((1, "money", f"{a[7]:.0f} flows {a[0]} -> {b[0]}"))
            if a[0] < b[0]:
                want[pair] += [(2, "shared", f"same account {a[1]}")] * (a[1] == b[1] is not None)
                want[pair] += [(3, "shared", f"same phone {a[3]}")] * (a[3] == b[3] is not None)
                want[pair] += [(4, "time", "within 30 min")] * (a[4] is not None and b[4] is not None and abs(a[4] - b[4]) <= 1800)
    got = relationship_links(spark.createDataFrame(rows, SCHEMA))
    assert {(r.source, r.target): (r.strength, r.kinds, r.details) for r in got.collect()} == {
        k: (len(v), [x[1] for x in sorted(v)], [x[2] for x in sorted(v)]) for k, v in want.items() if v}
    assert got._jdf.queryExecution().optimizedPlan().toString().strip().startswith("Union")


def test_related_payments_are_the_first_of_each_reason(spark):
    rows = _rows(90, 90, 9)
    timed = [r for r in rows if r[4] is not None]
    asks = {"same_account": (1, (1,)), "same_receiver": (2, (2, 1)), "same_counterparty": (6, (6,)), "same_day": (5, (5,))}
    want = {}
    for a in timed:
        why = defaultdict(set)
        for reason, (own, offers) in asks.items():
            found = sorted((b[4], b[0]) for b in timed if a[own] is not None and a[own] in [b[o] for o in offers])
            for x in found[:6]:
                why[x].add(reason)
        kept = [x for x in sorted(why) if x[1] != a[0]][:5]
        want |= {(a[0], n): (other, ts, sorted(why[ts, other])) for n, (ts, other) in enumerate(kept, 1)}
    got = related_payments(spark.createDataFrame(rows, SCHEMA), 5)
    assert {(r.txn_id, r.n): (r.other_id, r.other_ts, r.reasons) for r in got.collect()} == want
    assert "Window" not in "".join(got._jdf.queryExecution().optimizedPlan().toString().splitlines()[:4])
