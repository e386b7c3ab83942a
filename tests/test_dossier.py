"""Cards, dossiers and journeys on a hand-made case with nulls, empty values and entities named twice."""

import pytest

from weftline.case import Case
from weftline.plans import dossier as ds

BANK = """txn_id string, bank string, account_no string, receiver_account string, sender_phone string, receiver_phone string, upi_id string, counterparty_name string,
          txn_type string, mode string, narration string, credit double, debit double, ts long, date string, time string"""
CDR = "cdr_id string, a_number string, b_number string, imei string, imsi string, call_type string, duration_sec long, cell_id_first string, cell_id_last string, ts long"
IPDR = "ipdr_id string, msisdn string, imei string, imsi string, source_ip string, dest_ip string, duration_sec long, start_ts long"


@pytest.fixture(scope="module")
def case(spark):
    pay = [("T1", "B", "A", "R1", "1", "2", None, "Asha", "D", "UPI", "first", None, 600000.0, 100, None, None),
           ("T2", "B", "A", "A", "1", "1", "u@x", "", "C", None, None, 50.0, None, 100, None, None),
           ("T3", "B", None, "R1", None, None, None, "ASHA", "D", "ATM", "x" * 100, None, 7.0, None, None, None),
           ("T4", "B", "A", "R0", "1", "2", None, "asha", "D", "UPI", "later", None, 5000.0, 300, None, None)]
    calls = [("C1", "1", "1", "I", None, "SMS", 0, "K", None, 90), ("C2", "1", "3", "I", "S", "OUT", None, None, "L", 310), ("C3", "3", "1", None, "", None, 5, None, None, None)]
    sessions = [("I1", "1", "I", "S", "10.0.0.1", None, 4, 100)]
    complaints = [("A", "1"), ("A", None), (None, "1")]
    return Case(spark.createDataFrame(pay, BANK), spark.createDataFrame(calls, CDR), spark.createDataFrame(sessions, IPDR),
                spark.createDataFrame(complaints, "account_no string, mobile string").selectExpr("*", "cast(null as string) as state"), None)


def _by_key(df):
    return {(r.kind, r.value): r for r in df.collect()}


def test_an_event_posts_once_to_each_entity(case):
    rows = {(r.kind, r.value, r.record_id): r.own for r in ds.postings(case).collect()}
    assert len(rows) == ds.postings(case).count()
    assert rows[("account", "A", "T2")] and rows[("phone", "1", "T2")] and not rows[("account", "R1", "T1")]
    assert rows[("phone", "1", "C1")] and not rows[("phone", "1", "C3")]
    assert not [k for k in rows if not k[1]]


def test_cards(case):
    cards = _by_key(ds.full_cards(case))
    a, one = cards[("account", "A")], cards[("phone", "1")]
    assert (a.transactions, a.credit, a.debit, a.round_amounts, a.first_ts, a.last_ts, a.complaints) == (3, 50.0, 605000.0, 2, 100, 300, 2)
    assert a.receivers == ["R0", "R1"] and a.phones == ["1", "2"] and a.names == ["Asha", "asha"] and "COMPLAINED_ACCOUNT" in a.flags
    assert (one.transactions, one.calls, one.sms, one.ip_sessions, one.complaints) == (3, 1, 1, 1, 2)
    assert one.imeis == ["I"] and one.phones == ["2", "3"] and one.ips == ["10.0.0.1"] and one.towers == ["K", "L"]
    assert ("account", "R1") not in cards and cards[("name", "asha")].transactions == 3


def test_dossiers(case):
    found = _by_key(ds.dossiers(case))
    a, r1, asha = found[("account", "A")], found[("account", "R1")], found[("name", "asha")]
    assert (a.inflow, a.outflow, a.n_receivers, a.layering) == (50.0, 605000.0, 2, "STANDARD")
    assert (r1.transactions, r1.inflow, r1.outflow, r1.risk_score, r1.risk_band) == (2, 600007.0, 0.0, 45.0, "MEDIUM")
    assert r1.rules == ["HIGH_VALUE_VOLUME", "SEVERAL_LINES"]
    assert (asha.inflow, asha.n_receivers, asha.receivers) == (605007.0, 2, ["R0", "R1"])


def test_lists_keep_ties_in_order(case):
    posts = ds.postings(case)
    steps = [(r.step, r.record_id) for r in ds.journeys(posts).where("kind = 'phone' and value = '1'").orderBy("step").collect()]
    assert steps == [(1, "C1"), (2, "T1"), (3, "T2"), (4, "I1"), (5, "T4"), (6, "C2")]
    assert [r.record_id for r in ds.journeys(posts, 2).where("kind = 'phone' and value = '1'").orderBy("step").collect()] == ["C1", "T1"]
    records = [r.record_id for r in ds.card_records(posts).where("kind = 'account' and value = 'A'").orderBy("n").collect()]
    assert records == ["T4", "T1", "T2"]
    got = {(r.value, r.receiver_account): (r.total_received, r.payments, r.n) for r in ds.dossier_receivers(posts).where("kind = 'account'").collect()}
    assert got == {("A", "R0"): (5000.0, 1, 1), ("A", "R1"): (600000.0, 1, 2)}


def test_empty_case(case):
    none = Case(*(df.limit(0) for df in (case.bank, case.cdr, case.ipdr, case.complaints)), None)
    assert ds.full_cards(none).count() == ds.dossiers(none).count() == ds.journeys(ds.postings(none)).count() == 0
