"""Canonical projections, exports and running medians over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, entry
from weftline.functions import narration
from weftline.operators import links
from weftline.operators.ordering import with_position
from weftline.operators.running_median import running_median
from weftline.operators.views import canonical_calls, canonical_complaints, canonical_sessions, canonical_subscribers
from weftline.plans import reports as rp
from weftline.sources import bank as bk
from weftline.sources.folder import flat_fused


@entry("p1_normalised_bank", """
SELECT narration, mode, txn_type, date, time, ts, coalesce(upi_id, '') AS upi_id, coalesce(counterparty_name, '') AS counterparty_name,
  CASE WHEN mode IN ('IMPS', 'NEFT') THEN receiver_account ELSE '' END AS receiver_account, amount FROM f_bank WHERE amount > 0""")
def p1(t: Tables):
    parsed = t.bank.select(F.lit("ledger").alias("file"), F.substring("txn_id", 2, 20).cast("int").alias("line"), "date", "time", "narration",
                           "debit", "credit", "balance", "account_no")
    n = bk.usable(bk.normalise(parsed))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return n.select("narration", "mode", "txn_type", "date", "time", "ts", blank("upi_id"), blank("counterparty_name"), blank("receiver_account"),
                    F.coalesce("debit", "credit").alias("amount"))


@entry("x23_channel_and_counterparty", """
SELECT txn_id, mode AS channel, CASE mode WHEN 'UPI' THEN counterparty_name WHEN 'ATM' THEN 'ATM CASH' WHEN 'POS' THEN 'POS SWIPE'
  ELSE array_to_string(list_slice(string_split(narration, ' '), 1, 2), ' ') END AS label FROM f_bank""")
def x23(t: Tables):
    none = F.lit(None).cast("string")
    return t.bank.select("txn_id", narration.channel(none, F.col("narration")).alias("channel"),
                         narration.counterparty_label(F.col("counterparty_name"), F.col("narration")).alias("label"))


@entry("s18_flat_fused_export", """
SELECT transaction_id, date, mode, amount, direction, account_no, receiver_account, call_count, ipdr_count, complained FROM fused""")
def s18(t: Tables):
    return flat_fused(links.fused_rows(t.case)).select("transaction_id", "date", "mode", "amount", "direction", "account_no", "receiver_account",
                                                       "call_count", "ipdr_count", "complained")


@entry("w2_running_median", "SELECT txn_id, hmedian AS feat_historical_median FROM hist")
def w2(t: Tables):
    rows = with_position(t.bank.select("txn_id", "account_no", "ts", "amount"), ["account_no"], "txn_id")
    return rows.join(running_median(rows, "account_no", "amount"), ["account_no", "pos"]).select(
        "txn_id", F.col("median").alias("feat_historical_median"))


@entry("c8_report_section_sizes", """
SELECT 'modes' AS section, count(DISTINCT mode) AS records FROM f_bank UNION ALL SELECT 'circles', count(DISTINCT roaming_circle) FROM f_cdr UNION ALL SELECT 'benford', 9
UNION ALL SELECT 'session_hours', count(DISTINCT (start_ts % 86400) // 3600) FROM f_ipdr UNION ALL SELECT 'parties', 45 UNION ALL SELECT 'bank_matrix', count(*) FROM (SELECT DISTINCT bank, coalesce(counterparty_bank, '') FROM f_bank)
UNION ALL SELECT 'amounts', 8 UNION ALL SELECT 'activity', count(DISTINCT (ts % 86400) // 3600) + count(DISTINCT (ts // 86400) % 7) + count(DISTINCT ((ts // 86400) % 7) * 24 + (ts % 86400) // 3600) FROM f_bank""")
def c8(t: Tables):
    """Rows of the light report sections (each section also has its own check)."""
    return section_sizes(rp.report_tables(t.case, ("activity", "amounts", "modes", "session_hours", "bank_matrix", "circles", "parties", "benford")))


@entry("c8_report_section_sizes_all")
def c8b(t: Tables):
    """Rows of every report section."""
    return section_sizes(rp.report_tables(t.case))


def section_sizes(tables):
    out = None
    for name, table in tables.items():
        one = table.agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("section"), "records")
        out = one if out is None else out.unionByName(one)
    return out


@entry("p2_canonical_calls", "SELECT cdr_id, a_number, b_number, imei, imsi, duration_sec, cell_id_first, ts FROM f_cdr")
def p2(t: Tables):
    raw = t.cdr.withColumns({"a_number": F.concat(F.lit("+"), "a_number"), "b_number": F.substring("b_number", 3, 10), "imei": F.concat(F.lit("'"), "imei"),
                             "duration_sec": F.col("duration_sec").cast("string")}).drop("ts")
    return canonical_calls(raw).select("cdr_id", "a_number", "b_number", "imei", "imsi", "duration_sec", "cell_id_first", "ts")


@entry("p3_canonical_subscribers", "SELECT sub_id, msisdn, imsi, imei, subscriber_name, circle FROM f_sub")
def p3(t: Tables):
    raw = t.subscribers.withColumn("msisdn", F.concat(F.lit("0"), F.substring("msisdn", 3, 10)))
    return canonical_subscribers(raw).select("sub_id", "msisdn", "imsi", "imei", "subscriber_name", "circle")


@entry("p4_canonical_complaints", "SELECT complaint_id, account_no, mobile, state FROM f_complaint")
def p4(t: Tables):
    raw = t.complaints.withColumn("account_no", F.concat(F.lit("A/C "), "account_no"))
    return canonical_complaints(raw).select("complaint_id", "account_no", "mobile", "state")


@entry("p5_canonical_sessions", "SELECT ipdr_id, msisdn, imsi, imei, source_ip, start_ts, duration_sec, volume_down FROM f_ipdr")
def p5(t: Tables):
    raw = t.ipdr.withColumns({"msisdn": F.substring("msisdn", 3, 10), "source_ip": F.concat(F.lit(" "), "source_ip")}).drop("start_ts")
    return canonical_sessions(raw).select("ipdr_id", "msisdn", "imsi", "imei", "source_ip", "start_ts", "duration_sec", "volume_down")
