"""Queries that read all alerts, all calls and all report sections, held against plain Python."""

from collections import Counter

import pytest

import __spark_entry__ as entry_module
from catalog.base import Tables
from catalog.composites import scored
from weftline import standins
from weftline.operators import graphs as g

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def queries():
    return entry_module.queries()


@pytest.fixture(scope="module")
def alerted(spark):
    """Rows of the alerted payments: risk of 50 and more, 60 being added for complained accounts."""
    complained = {r.account_no for r in standins.complaints(spark, SF).collect()}
    risk = {r.transaction_id: r.risk_score + 60 * (r.account_no in complained) for r in scored(Tables(spark, SF)).collect()}
    return [r for r in standins.bank(spark, SF).collect() if risk.get(r.txn_id, 0) >= 50]


def test_red_flags_and_narratives_follow_the_alert_feed(spark, queries, alerted):
    ids = sorted(r.txn_id for r in alerted)
    assert any((r.debit or 0) < 300000 for r in alerted)
    assert sorted(r.txn_id for r in queries["c7_narratives"](spark, SF).collect()) == ids
    assert sorted(r.txn_id for r in queries["c6_red_flags_alert_feed"](spark, SF).collect()) == ids


def test_links_among_all_alerted_payments(spark, queries, alerted):
    want = Counter()
    for a in alerted:
        for b in alerted:
            if a.txn_id != b.txn_id:
                pair = (min(a.txn_id, b.txn_id), max(a.txn_id, b.txn_id))
                want[pair] += a.receiver_account == b.account_no
                if a.txn_id < b.txn_id:
                    want[pair] += (a.account_no == b.account_no) + (a.sender_phone == b.sender_phone) + (abs(a.ts - b.ts) <= 1800)
    got = {(r.source, r.target): r.strength for r in queries["j10_relationship_links_alert_feed"](spark, SF).collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_short_calls_count_for_the_call_graph(spark, queries):
    cdr = standins.cdr(spark, SF)
    rank = {r.node: r.pagerank for r in queries["g10_pagerank_calls"](spark, SF).collect()}
    assert cdr.where("duration_sec < 10").count() > 0 and set(rank) == {n for r in cdr.collect() for n in (r.a_number, r.b_number)}
    assert rank == {r.node: round(r.pagerank, 8) for r in g.pagerank(g.call_edges(cdr)).collect()}


def test_every_report_section_is_measured(spark, queries):
    sizes = {r.section: r.records for r in queries["c8_report_section_sizes_all"](spark, SF).collect()}
    assert len(sizes) == 31 and {"loops", "payouts", "rapid_in_out", "missing_links", "account_risk", "recommendations", "importance"} <= set(sizes) and sizes["typologies"] == 6
