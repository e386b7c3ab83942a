"""Sequences of funds, networks and telecom of the day against plain Python, with nulls, ties and a long ledger."""

import random

import pytest
from test_dossier import BANK, CDR, IPDR

from weftline.case import Case
from weftline.plans import case_parts as cs

DAY = 86400


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(5)
    pay = []
    for n in range(240):
        account = "HOT" if n % 3 == 0 else rnd.choice(["A", "B", "C", None])
        credit = rnd.random() < 0.5
        amount = float(rnd.randint(0, 9) * 100)
        pay.append((f"T{n:03}", "B", account, rnd.choice(["HOT", "A", "B", None, ""]), rnd.choice(["1", "2", None]), rnd.choice(["1", "3", None]), None, rnd.choice(["Asha", None]),
                    "C" if credit else "D", "UPI", "x", amount if credit else None, None if credit else amount, rnd.choice([None, rnd.randint(0, 5) * DAY]),
                    rnd.choice([None, "2024-01-01", "2024-01-02"]), rnd.choice([None, "10:00:00"])))
    calls = [(f"C{n:02}", rnd.choice(["1", "2"]), rnd.choice(["1", "3"]), None, None, "OUT", 1, None, None, rnd.choice([None, rnd.randint(0, 5) * DAY])) for n in range(90)]
    sessions = [(f"I{n:02}", rnd.choice(["1", "2", "3", None]), rnd.choice(["D1", "D2", "", None]), None, rnd.choice(["10.0.0.1", f"10.0.1.{n}"]), None, 1, rnd.randint(0, 5) * DAY) for n in range(80)]
    return pay, calls, sessions


@pytest.fixture(scope="module")
def case(spark, data):
    pay, calls, sessions = data
    return Case(spark.createDataFrame(pay, BANK).selectExpr("*", "cast(null as string) as account_name", "cast(null as string) as customer_id"), spark.createDataFrame(calls, CDR), spark.createDataFrame(sessions, IPDR),
                spark.createDataFrame([], "account_no string, mobile string, state string"), None)


def test_sequence(case, data):
    pay = data[0]
    alerts = case.bank.select("txn_id")
    want = {}
    order = lambda r: (r[14] or "", r[15] or "", r[0])
    for a in pay:
        ins = sorted((r for r in pay if r[2] == a[2] and a[2] is not None and (r[11] or 0) > 0), key=order)
        outs = sorted((r for r in pay if r[2] == a[3] and a[3] is not None and (r[12] or 0) > 0), key=order)
        balance, steps = 0.0, []
        for kind, r in [("INFLOW", r) for r in ins] + [("ALERT", a)] + [("OUTFLOW", r) for r in outs]:
            amount = r[11] if r[11] is not None else r[12]
            balance += amount if kind == "INFLOW" else -amount
            steps.append((len(steps) + 1, kind, r[0], f"{r[14] or ''} {r[15] or ''}".strip(), amount, balance))
        want[a[0]] = steps[:30]
    got = {}
    for r in cs.fund_sequence(case.bank, alerts.unionByName(alerts)).orderBy("txn_id", "step").collect():
        got.setdefault(r.txn_id, []).append((r.step, r.direction, r.entry, r.at, r.amount, r.balance))
    assert got == want
    assert any(len(s) == 30 for s in want.values())


def test_network_and_quality(case, data):
    pay = data[0]
    got = {r.txn_id: (r.connected, r.payers, r.neighbours) for r in cs.alert_network(case.bank, case.bank.select("txn_id"), 3).collect()}
    assert len(got) == len(pay)
    for a in pay:
        paid = {r[3] if r[3] is not None else r[7] for r in pay if r[2] == a[2]} if a[2] is not None else set()
        payers = {r[2] for r in pay if r[3] == a[2]} - {None, ""} if a[2] is not None else set()
        every = sorted((paid | payers) - {None, ""})
        assert got[a[0]] == (len(every), len(payers), every[:3])
    quality = {r.txn_id: r for r in cs.data_quality(case, case.bank.select("txn_id")).collect()}
    assert all(q.bank_records == 240 and "complaint ledger" in q.missing and "customer identity" in q.missing for q in quality.values())
    assert all(("receiver account" in quality[a[0]].missing) == (not a[3]) for a in pay)


def test_telecom(case, data):
    pay, calls, sessions = data
    day = lambda ts: (ts + 19800) // DAY
    got = {r.txn_id: r for r in cs.telecom_of_day(case, case.bank.select("txn_id"), 4, 2).collect()}
    for a in pay:
        phone = a[4] or a[5]
        on = sorted((c[9], c[0]) for c in calls if c[9] is not None and a[13] is not None and phone in (c[1], c[2]) and day(c[9]) == day(a[13])) if phone else []
        ses = sorted((s[7], s[0]) for s in sessions if phone and s[1] == phone and a[13] is not None and day(s[7]) == day(a[13]))
        users = {}
        for s in sessions:
            if s[2] and s[1]:
                users.setdefault(s[2], set()).add(s[1])
        shared = sorted(d for d, u in users.items() if len(u) > 1 and phone in u)
        r = got[a[0]]
        assert (r.n_calls, r.calls, r.n_sessions, r.sessions, r.devices) == (len(on), [i for _, i in on[:4]], len(ses), [i for _, i in ses[:2]], shared)
