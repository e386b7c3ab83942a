"""Every registered query has a stable schema; a sample is compared with its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ("j1_phone_coincidence", "j2_fused_rows", "j4_call_session_links", "j11_rapid_in_out", "w8_velocity", "w14_rapid_payouts", "a21_entity_risk", "g6_circular_flows", "c1_entity_cards")


def test_checks_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries()) and len(entry_module.queries()) > 150


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry_module.queries()[name](spark, SF)
    cur = db.execute(entry_module.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)

    def norm(v):
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    want = sorted(map(str, ([norm(r[cols.index(c)]) for c in sorted(cols)] for r in cur.fetchall())))
    assert sorted(map(str, ([norm(r[c]) for c in sorted(cols)] for r in df.collect()))) == want


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_scoring_reads_the_events_once_for_each_kind(spark):
    """Payments, calls and sessions are written once; what the scores and the alerts read afterwards is not the events file."""
    from catalog.base import Tables
    from catalog.composites import scored

    t = Tables(spark, "/root/testdata/sf0.001")
    before = [df.collect() for df in (t.bank, t.cdr, t.ipdr)]
    scored(t)
    assert all(sorted(df.collect(), key=str) == sorted(rows, key=str) for df, rows in zip((t.case.bank, t.case.cdr, t.case.ipdr), before))
    assert not any("events.parquet" in f for df in (t.bank, t.case.bank, t.case.cdr, t.case.ipdr) for f in df.inputFiles())
