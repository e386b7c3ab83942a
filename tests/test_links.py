"""Device sharing with crowded devices, and rapid in-out edges, against brute force."""

import random
from collections import Counter

from weftline.operators.links import rapid_in_out, shared_device_phones


def test_crowded_devices_give_the_same_answer(spark):
    rnd = random.Random(5)
    rows = [(f"p{rnd.randrange(25):02d}", rnd.choice(["junk", "junk2", f"d{rnd.randrange(12)}"])) for _ in range(400)]
    cdr = spark.createDataFrame(rows, "a_number string, imei string")
    use = Counter(rows)
    phones = sorted({p for p, _ in rows})
    want = set()
    for p in phones:
        tot = Counter()
        for (q, d), n in use.items():
            if q != p and (p, d) in use:
                tot[q] += n
        want |= {(p, q, n, r) for r, (q, n) in enumerate(sorted(tot.items(), key=lambda x: (-x[1], x[0]))[:3], 1)}
    got = {(r.phone, r.other, r.records, r["rank"]) for r in shared_device_phones(cdr, top=3).collect()}
    assert got == want


def test_rapid_in_out_is_strictly_later_and_first(spark):
    rows = [("c1", "a", 100, None, 1000.0), ("d0", "a", 100, 1000.0, None), ("d1", "a", 150, 900.0, None), ("d2", "a", 1000, 950.0, None),
            ("d3", "a", 1000, 1000.0, None), ("c2", "b", 100, None, 10.0), ("d4", "b", 1001, 10.0, None)]
    bank = spark.createDataFrame(rows, "txn_id string, account_no string, ts long, debit double, credit double").selectExpr("*", "'UPI' as mode")
    assert [(r.in_txn, r.out_txn, r.latency) for r in rapid_in_out(bank).collect()] == [("c1", "d2", 900)]
