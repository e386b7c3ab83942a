"""Payments and calls on shared phones: right pairs, and none of them shuffled."""

import random

from weftline.case import Case
from weftline.operators.links import bank_call_links, call_session_links, pair_counts, payment_sessions, payments_by_device
from weftline.plans.validation import pair_quality, window_quality


def test_pairs_on_two_phones_and_repeated_ids(spark):
    rnd = random.Random(8)
    phone = lambda: rnd.choice([None, "919000000001", "919000000002", "919000000003"])
    pay = [(f"t{rnd.randrange(40)}", rnd.choice([None, *range(0, 4000, 50)]), phone(), phone()) for _ in range(60)]
    calls = [(f"c{rnd.randrange(40)}", rnd.choice([None, *range(0, 4000, 70)]), phone(), phone()) for _ in range(60)]
    want = {}
    for t, at, *p in pay:
        for c, when, *q in calls:
            if at is not None and when is not None and abs(at - when) <= 300 and (set(p) & set(q)) - {None}:
                want[t, c] = min(want.get((t, c), 999), abs(at - when))
    case = Case(bank=spark.createDataFrame(pay, "txn_id string, ts long, sender_phone string, receiver_phone string"),
                cdr=spark.createDataFrame(calls, "cdr_id string, ts long, a_number string, b_number string"), ipdr=None, complaints=None, subscribers=None)
    links = bank_call_links(case)
    got = [(r.txn_id, r.cdr_id, r.time_diff) for r in links.collect()]
    assert sorted(got) == sorted((t, c, d) for (t, c), d in want.items())
    plan = links._jdf.queryExecution().optimizedPlan().toString().strip()
    assert not plan.startswith("Aggregate")


def test_rows_of_both_ends_travel_with_the_pairs(spark):
    """The same as joining them to the pairs, with repeated, missing and dropped ids, and no join above that of the pairs."""
    bank = spark.createDataFrame([("t1", 0, "919000000001", None), ("t2", 10, "919000000001", "919000000002"), ("t3", 20, "919000000002", None)],
                                 "txn_id string, ts long, sender_phone string, receiver_phone string")
    cdr = spark.createDataFrame([("c1", 5, "919000000001", "919000000002"), ("c2", 30, "919000000002", None), ("c3", 9000, "919000000001", None)],
                                "cdr_id string, ts long, a_number string, b_number string")
    case = Case(bank=bank, cdr=cdr, ipdr=None, complaints=None, subscribers=None)
    pay = spark.createDataFrame([("t1", 1.0, "x"), ("t2", 2.0, None), ("t2", 3.0, "y")], "txn_id string, amount double, who string")
    call = cdr.select("cdr_id", "b_number")
    got = bank_call_links(case, pay=pay, call=call)
    want = bank_call_links(case).join(pay, "txn_id").join(call, "cdr_id").select(got.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key) and want.count() == 5
    top = next(line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)
    assert "__bucket" in top


def test_pairs_are_counted_without_being_formed(spark):
    """Two shared keys, repeated ids, ids without a name, many keys: as many pairs as there are; and links held against links of another window."""
    rnd = random.Random(5)
    side = lambda name, n, keys: [(rnd.choice([None, *[f"{name}{i}" for i in range(n)]]), rnd.choice([None, *range(0, 2000, 30)]), f"k{rnd.randrange(keys)}")
                                  for _ in range(n * 2)] + [(f"{name}x{i}", 40 * i, f"k{k}") for i in range(40) for k in {i % keys, i * 7 % keys}]
    left, right = side("p", 25, 4), side("e", 25, 4)
    want = {w: {(a, b) for a, t, k in left for b, at, m in right if k == m and t is not None and at is not None and abs(t - at) <= w} for w in (60, 300)}
    counts = pair_counts(*[spark.createDataFrame(x, "id string, ts long, key string") for x in (left, right)], (60, 300))
    assert {r.window_sec: r.pairs for r in counts.collect()} == {w: len(v) for w, v in want.items()}
    near, far = (spark.createDataFrame(sorted(want[w], key=str), "a string, b string") for w in (60, 300))
    for one, two, a, b in ((near, far, 60, 300), (far, near, 300, 60)):
        q = pair_quality(one, two).first()
        if not any(None in x for x in want[300]):
            assert window_quality(counts, a, b).first() == q
    q = window_quality(counts, 60, 300).first()
    assert (q.tp, q.fp, q.fn) == (len(want[60]), len(want[300]) - len(want[60]), 0)


def test_sessions_behind_payments(spark):
    """Rows and counts equal to joining links, calls and sessions; repeated and missing ids, payments on two phones and without a link."""
    rnd = random.Random(11)
    phone = lambda: rnd.choice([None, "919000000001", "919000000002", "919000000003"])
    at = lambda: rnd.choice([None, *range(0, 9000, 45)])
    pay = [(rnd.choice([None, *[f"t{i}" for i in range(90)]]), f"a{i % 4}", at(), phone(), phone()) for i in range(90)]
    calls = [(rnd.choice([None, *[f"c{i}" for i in range(50)]]), at(), phone(), phone(), f"m{rnd.randrange(3)}", f"s{rnd.randrange(3)}") for _ in range(50)]
    sess = [(f"i{rnd.randrange(30)}", at(), phone(), f"s{rnd.randrange(3)}", rnd.choice([None, "m0", "m1"]), f"10.0.0.{rnd.randrange(2)}") for _ in range(30)]
    case = Case(bank=spark.createDataFrame(pay, "txn_id string, account_no string, ts long, sender_phone string, receiver_phone string"),
                cdr=spark.createDataFrame(calls, "cdr_id string, ts long, a_number string, b_number string, imei string, imsi string"),
                ipdr=spark.createDataFrame(sess, "ipdr_id string, start_ts long, msisdn string, imsi string, imei string, source_ip string"), complaints=None, subscribers=None)
    links = {(r.txn_id, r.cdr_id) for r in bank_call_links(case).collect()}
    near = {(r.cdr_id, r.ipdr_id) for r in call_session_links(case).collect()}
    want = []
    for t, account, *_ in pay:
        for c in [c for x, c in links if x == t and t is not None] or [None]:
            for imei, imsi in [r[4:] for r in calls if r[0] == c and c is not None] or [(None, None)]:
                for i in [i for x, i in near if x == c and c is not None] or [None]:
                    for ip, other in [(r[5], r[4]) for r in sess if r[0] == i] or [(None, None)]:
                        want.append((t, account, c, imei, imsi, i, ip, other))
    rows = payment_sessions(case)
    assert sorted(map(str, (tuple(r) for r in rows.collect()))) == sorted(map(str, want))
    devices = {}
    for t, *_, i, ip, imei in want:
        if i is not None:
            devices.setdefault((ip, imei), set()).add(t)
    got = {(r.source_ip, r.session_imei): r.payments for r in payments_by_device(case).collect()}
    assert len(devices) > 3 and got == {k: len(v) for k, v in devices.items()}
