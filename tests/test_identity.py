"""Confirmed identifier types against plain Python, with blanks, short texts and texts of several kinds."""

from weftline.case import Case
from weftline.functions.hints import identifier_type
from weftline.operators.identity import CERTAIN, confirmed_types

VALUES = ["9876543210", "12345", "ACK77", "5000123", " 5000123 ", "43210", "0043210", "", None, "abc", "10.0.0.1", "T12345678", "919876543210", "00009876543210", "77", "0", "ACK77"]


def test_confirmed_types(spark):
    complaints, accounts, numbers = ["ACK77", "12345", None, ""], [("5000123", "ACK77"), (None, "12345"), ("43210", None)], ["919876543210", None, "77"]
    case = Case(spark.createDataFrame(accounts, "account_no string, receiver_account string"), None, None, spark.createDataFrame([(c,) for c in complaints], "ack_no string"), spark.createDataFrame([(n,) for n in numbers], "msisdn string"))
    values = spark.createDataFrame([(v,) for v in VALUES], "value string")
    form = {r.value: r.form for r in values.select("value", identifier_type(values.value).alias("form")).collect()}
    want = {}
    for v in set(VALUES):
        t, s = form[v], (v or "").strip()
        if t not in CERTAIN and s:
            if s in complaints:
                t = "complaint"
            elif any(s in row for row in accounts):
                t = "account"
            elif any(n and n.endswith(s[-10:]) for n in numbers):
                t = "phone"
        want[v] = t
    got = [(r.value, r.type) for r in confirmed_types(values, case).collect()]
    assert dict(got) == want and len(got) == len(want)
    assert {"complaint", "account", "phone"} <= set(want.values()) and want["43210"] == "account" and want["77"] == "phone"
    none = Case(*(df.limit(0) if df is not None else None for df in (case.bank, None, None, case.complaints, case.subscribers)))
    assert {r.value: r.type for r in confirmed_types(values, none).collect()} == form
