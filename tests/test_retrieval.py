"""Evidence rows and snippets for requests of every kind, against a plain version."""

import re

import pytest
from pyspark.sql import functions as F

from weftline import standins
from weftline.case import Case
from weftline.functions.hints import MODES, PATTERNS, PLACES
from weftline.operators.views import bank_legs
from weftline.plans import retrieval as rt

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def case(spark):
    c = Case(*(f(spark, SF) for f in (standins.bank, standins.cdr, standins.ipdr, standins.complaints, standins.subscribers)))
    tower = F.when(F.col("cdr_id").endswith("3"), F.lit("NewDelhi South")).when(F.col("cdr_id").endswith("7"), F.lit("WestBengal 4"))
    return Case(c.bank, c.cdr.withColumn("bts_location_first", tower), c.ipdr, c.complaints, c.subscribers)


def plain(text, t, top_k=8):
    """Rows as (table, id, hint), in order, from dicts of rows."""
    h = {k: list(dict.fromkeys(re.findall(p, text))) for k, p in PATTERNS.items()}
    for k in ("txn", "cdr", "ipdr"):
        h[k] = list(dict.fromkeys(v.upper() for v in h[k]))
    h["account"] = [a for a in h["account"] if a not in h["phone"] and a not in h["imei"]]
    out = []
    names = {"bank": "txn_id", "cdr": "cdr_id", "ipdr": "ipdr_id", "subscriber": "sub_id", "complaint": "complaint_id"}

    def add(table, fits, by, most, key=lambda r: ()):
        rows = sorted((r for r in t[table] if fits(r)), key=lambda r: (*key(r), r[names[table]]))[:most]
        out.extend((table, r[names[table]], by) for r in rows)

    ten = lambda v: (v or "")[-10:]
    for v in h["phone"]:
        for table, cols, most in (("bank", ("sender_phone", "receiver_phone"), 3), ("cdr", ("a_number", "b_number"), 3), ("ipdr", ("msisdn",), 3), ("subscriber", ("msisdn",), 2)):
            add(table, lambda r: v in [ten(r[c]) for c in cols], "phone", most)
    for k, table in (("txn", "bank"), ("cdr", "cdr"), ("ipdr", "ipdr")):
        for v in h[k]:
            add(table, lambda r: r[names[table]] == v, k, 3)
    for v in h["account"]:
        add("bank", lambda r: v in (r["sender_account"], r["receiver_account"]), "account", 3)
        add("complaint", lambda r: r["account_no"] == v, "account", 2)
    for v in h["imei"]:
        add("ipdr", lambda r: r["imei"] == v, "imei", 3)
    for v in h["ip"]:
        add("ipdr", lambda r: v in (r["source_ip"], r.get("dest_ip")), "ip", 3)
    amounts = [float(n.replace(",", "")) * {"crore": 1e7, "lakh": 1e5, "k": 1e3}.get(u.lower(), 1) for n, u in re.findall(r"(?i)\b(?:inr|rs\.?|₹)?\s*([\d,]+(?:\.\d+)?)\s*(lakh|crore|k)?", text) if n.replace(",", "")]
    amounts = [a for a in amounts if 100 <= a <= 1e10]
    if amounts:
        add("bank", lambda r: r["amount"] >= max(amounts), "amount", 5, lambda r: (-r["amount"],))
    for m in MODES:
        if m in text.upper():
            add("bank", lambda r: (r["mode"] or "").upper() == m, "mode", 5, lambda r: (-r["amount"],))
    for p in PLACES:
        if p in text.lower():
            add("cdr", lambda r: p.replace(" ", "") in ((r["bts_location_first"] or "") + "\n" + (r.get("roaming_circle") or "")).lower(), "location", 5)
    if not out:
        word = next((w for w in re.findall(r"\b([A-Za-z]{2,6}\d[A-Za-z0-9]{4,})\b", text)), None)
        for table in ("bank", "cdr", "ipdr"):
            add(table, lambda r: word and r[names[table]].lower() == word.lower(), "candidate", 3)
    if not out:
        size = {"bank": lambda r: (-r["amount"],), "cdr": lambda r: (-(r["duration_sec"] or 0),), "ipdr": lambda r: (-(r["duration_sec"] or 0),), "complaint": lambda r: ()}
        table = next((table for words, table in rt.INTENTS if any(w in text.lower() for w in words)), None)
        if table:
            add(table, lambda r: True, "general", 8, size[table])
    seen = {}
    for table, i, by in out:
        seen.setdefault((table, i), by)
    return [(*k, by) for k, by in seen.items()][:top_k]


def test_requests_of_every_kind(spark, case):
    legs = bank_legs(case.bank)
    t = {n: [r.asDict() for r in df.collect()] for n, df in (("bank", legs), ("cdr", case.cdr), ("ipdr", case.ipdr), ("subscriber", case.subscribers), ("complaint", case.complaints))}
    pay, call, session, complaint = t["bank"][0], t["cdr"][0], t["ipdr"][0], t["complaint"][0]
    texts = [f"who is {pay['sender_phone'][-10:]} and {call['b_number'][-10:]}", f"payments of 00{complaint['account_no']} or {complaint['account_no']}", f"device {session['imei']} on {session['source_ip']}",
             "payments above 2 lakh", "UPI and neft above 9 crore", "calls near delhi, west bengal", f"details of {pay['txn_id']}", "show the largest payments", "longest call", "any session?", "complaint status", "suspicious", "hello", "", None,
             "over 1,00,000 by IMPS in Delhi", "something of 150 rupees"]
    requests = spark.createDataFrame(list(enumerate(texts)), "request_id long, text string")
    rows = rt.retrieve(requests, case, legs).collect()
    got = {k: [(r.table, r.id, r.found_by) for r in sorted(rows, key=lambda r: r.pos) if r.request_id == k] for k in range(len(texts))}
    want = {k: plain(x or "", t) for k, x in enumerate(texts)}
    assert got == want
    assert {by for v in want.values() for _, _, by in v} >= {"phone", "imei", "ip", "amount", "mode", "location", "general"}
    money = {r["txn_id"]: r for r in t["bank"]}
    for r in rows:
        if r.table == "bank":
            m = money[r.id]
            assert r.snippet == (f"{r.id} ₹{m['amount']:,.0f} {m['mode'] or ''} {m['date'] or ''} {m['timestamp'] or ''} from={m['sender_account']} ({m['sender_name'] or ''}) "
                                 f"to={m['receiver_account']} ({m['receiver_name'] or ''})").strip()
        elif r.table == "cdr":
            c = next(x for x in t["cdr"] if x["cdr_id"] == r.id)
            assert r.snippet.startswith(f"{r.id} {c['date']} {c['time']} {c['call_type']} {c['duration_sec']}s {c['a_number']} -> {c['b_number']} tower={c['bts_location_first'] or ''}")
        assert r.snippet
