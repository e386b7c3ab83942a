"""An ingested folder held against its own labels, compared with plain sets."""

from test_ingest import SYN_BANK, SYN_CDR, SYN_IPDR

from weftline.plans import validation as va
from weftline.sources import folder as fd

SUSPICIOUS = """Anomaly_ID,Transaction_ID,IPDR_IDs,Scenario_Type,Source_Scope,Is_Suspicious,customer_id,cdr_ids,difficulty
A1,T1,P1;P9,mule,bank_cdr_ipdr,1,C1,K1;K7,hard
A2,T9,,burst,bank,1,C1,,easy
A3,T2,,burst,bank,0,C1,,easy
"""
BANK_CALLS = "Transaction_ID,CDR_ID,Time_Difference_Seconds,Is_Correlated\nT1,K1,-60,1\nT2,K2,400,1\nT2,K1,90,0\n"
CALLS_SESSIONS = "CDR_ID,IPDR_ID,Time_Difference_Seconds,Is_Correlated\nK1,P1,60,1\n"
SECOND_CALL = "K2,Jio,9876543210,9123456780,OUT,2024-01-06,10:36:40,30,404000000000001,356000000000001,C1,Surat,Gujarat\n"


def _report(spark, path, **files):
    for name, text in files.items():
        (path / f"{name}.csv").write_text(text)
    got = fd.ingest(spark, str(path))
    scores = spark.createDataFrame([("T1", 60.0), ("T2", 30.0)], "transaction_id string, risk_score double")
    rows = va.labelled_report(got.case, got.suspicious, got.bank_calls, got.calls_sessions, scores).collect()
    return {(r.section, r.item, r.measure): r.value for r in rows}


def test_report_of_a_labelled_folder(spark, tmp_path):
    got = _report(spark, tmp_path, bank_anomaly=SYN_BANK, cdr_anomaly=SYN_CDR + SECOND_CALL, ipdr_anomaly=SYN_IPDR, anomaly=SUSPICIOUS, bank_cdr=BANK_CALLS, cdr_ipdr=CALLS_SESSIONS)
    cover = {d: (got[("coverage", d, "total")], got[("coverage", d, "matched")]) for d in ("bank", "cdr", "ipdr")}
    assert cover == {"bank": (3, 2), "cdr": (3, 2), "ipdr": (2, 1)}
    link = lambda item: tuple(got[("links", item, m)] for m in ("tp", "fp", "fn", "recall"))
    assert link("bank_cdr/window") == (1, 0, 1, 0.5) and link("bank_cdr/labels") == (2, 0, 0, 1.0)
    assert link("cdr_ipdr/window") == (1, 0, 0, 1.0) == link("cdr_ipdr/labels")
    one = lambda item: tuple(got[("anomalies", item, m)] for m in ("tp", "fp", "fn", "tn"))
    assert one("50/*/*") == (1, 0, 1, 0) and one("25/*/*") == (1, 1, 1, 0) and one("75/*/*") == (0, 0, 2, 0)
    assert one("50/BANK/*") == (0, 1, 1, 0) and one("50/*/MULE") == (1, 0, 0, 1)


def test_report_without_labels(spark, tmp_path):
    got = _report(spark, tmp_path, bank_anomaly=SYN_BANK, cdr_anomaly=SYN_CDR)
    assert got[("coverage", "bank", "total")] == 0 and got[("coverage", "bank", "recall")] == 1
    assert got[("links", "bank_cdr/window", "tp")] == 0 and got[("links", "cdr_ipdr/labels", "fn")] == 0
