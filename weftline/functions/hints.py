"""Identifiers, amounts, modes and places named in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, payment words and places looked for.
PATTERNS = {
    "phone": r"\b(\d{10})\b",
    "txn": r"(?i)\b((?:TXN|ATM|UPI|IMPS|NEFT|RTGS|CHEQUE)[A-Za-z0-9]{4,})\b",
    "cdr": r"(?i)\b(CDR\d{6,})\b",
    "ipdr": r"(?i)\b(IPDR\d{6,})\b",
    "imei": r"\b(\d{15})\b",
    "ip": r"\b((?:\d{1,3}\.){3}\d{1,3})\b",
    "account": r"\b(\d{6,18})\b",
}
AMOUNT = r"(?i)\b(?:inr|rs\.?|₹)?\s*([\d,]+(?:\.\d+)?)\s*(lakh|crore|k)?"
CANDIDATE = r"\b([A-Za-z]{2,6}\d[A-Za-z0-9]{4,})\b"
MODES = ("UPI", "IMPS", "NEFT", "RTGS", "ATM", "CHEQUE", "NETBANKING", "PAYTM", "WALLET")
PLACES = ("west bengal", "kolkata", "delhi", "mumbai", "gujarat", "rajasthan", "bihar", "tamil nadu", "karnataka", "assam")


def _all(text: Column, name: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PATTERNS[name]), F.lit(1)))


def hints(text: Column) -> dict[str, Column]:
    """Arrays of everything recognised, over the whole text."""
    t = F.coalesce(text, F.lit(""))
    out = {k: _all(t, k) for k in PATTERNS}
    for k in ("txn", "cdr", "ipdr"):
        out[k] = F.transform(out[k], F.upper)
    out["account"] = F.array_except(F.array_except(out["account"], out["phone"]), out["imei"])
    up, low = F.upper(t), F.lower(t)
    out["mode"] = F.array_compact(F.array(*[F.when(F.contains(up, F.lit(m)), F.lit(m)) for m in MODES]))
    out["location"] = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in PLACES]))
    number = F.regexp_extract_all(t, F.lit(AMOUNT), F.lit(1))
    unit = F.regexp_extract_all(t, F.lit(AMOUNT), F.lit(2))
    scale = lambda u: F.when(F.lower(u) == "crore", 1e7).when(F.lower(u) == "lakh", 1e5).when(F.lower(u) == "k", 1e3).otherwise(1.0)
    value = F.zip_with(number, unit, lambda n, u: F.replace(n, F.lit(",")).try_cast("double") * scale(u))
    out["amount"] = F.filter(value, lambda v: (v >= 100) & (v <= 1e10))
    out["candidate"] = F.try_element_at(F.filter(F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(1)), lambda x: F.length(x) >= 6), F.lit(1))
    return out


def best_hint(h: dict[str, Column]) -> Column:
    """First value of the most telling kind."""
    return F.coalesce(*[F.try_element_at(h[k], F.lit(1)) for k in ("txn", "cdr", "ipdr", "account", "phone", "imei", "ip")])


def identifier_type(value: Column) -> Column:
    v = F.trim(F.coalesce(value, F.lit("")))
    d = F.regexp_replace(v, "[^0-9]", "")
    return (F.when(v == "", "identifier").when(v.rlike(r"^(?i)(TXN\w{3,}|T\d{8,})$"), "transaction")
            .when(v.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ip").when(v.rlike(r"^(?:35|86|99)\d{13}$"), "imei")
            .when(F.upper(v).rlike("^[A-Z]{4}0[A-Z0-9]{6}$"), "ifsc")
            .when((F.length(d) == 10) & d.rlike("^[6-9]"), "phone").when((F.length(d) == 12) & d.startswith("91"), "phone")
            .when(F.length(d) >= 4, "account").otherwise("identifier"))


def row_risk(amount: Column, stamp: Column, mode: Column, linked: Column, gap: Column) -> Column:
    """0-100 from value, hour, channel, linkage and roundness of one result row."""
    a = F.coalesce(amount, F.lit(0.0))
    hour = F.coalesce(F.substring(stamp, 12, 2).try_cast("int"), F.lit(-1))
    m = F.upper(F.coalesce(mode, F.lit("")))
    pts = lambda c, p: F.when(F.coalesce(c, F.lit(False)), p).otherwise(0)
    return F.least(F.lit(100), F.when(a >= 500000, 30).when(a >= 100000, 20).when(a >= 25000, 10).otherwise(0)
                   + pts(hour.between(0, 5) | (hour >= 22), 15)
                   + F.when(m.isin("UPI", "IMPS", "PAYTM", "WALLET"), 10).when(m.isin("NEFT", "RTGS", "CHEQUE", "NETBANKING"), 5).otherwise(0)
                   + pts(linked, 8) + pts(F.abs(F.coalesce(gap, F.lit(0.0))) <= 300, 8) + pts((a >= 10000) & (a % 1000 == 0), 8))
