"""Links between datasets."""

from __future__ import annotations


from pyspark.sql import functions as F

from catalog.base import Tables, entry, rounded, view
from catalog.composites import scored
from weftline.operators import links
from weftline.operators.views import bank_legs
from weftline.plans import composite as cp
from weftline.session import cut

JOIN = ","


def ids(array: str, field: str):
    return F.coalesce(F.array_join(F.transform(array, lambda x: x[field]), JOIN), F.lit(""))


@entry("j1_phone_coincidence", """
WITH s AS (SELECT a_number, count(ts) AS recs, count(*) AS contacts FROM f_cdr GROUP BY a_number),
hits AS (SELECT t.txn_id, t.receiver_phone AS phone, t.account_no, t.txn_type, t.mode,
    CASE WHEN txn_type = 'C' THEN credit ELSE debit END AS amount, recs, contacts
  FROM f_bank t JOIN s ON t.receiver_phone = s.a_number),
near AS (SELECT t.txn_id, c.cdr_id, row_number() OVER (PARTITION BY t.txn_id ORDER BY c.ts, c.cdr_id) AS n
  FROM f_bank t JOIN f_cdr c ON t.receiver_phone = c.a_number AND c.ts BETWEEN t.ts - 3600 AND t.ts + 3600),
agg AS (SELECT txn_id, count(*) AS window_count, string_agg(CASE WHEN n <= 20 THEN cdr_id END, ',' ORDER BY n) AS calls
  FROM near GROUP BY txn_id)
SELECT h.txn_id, phone, account_no, txn_type, mode, amount, recs AS phone_call_records, contacts AS phone_contacts,
  coalesce(window_count, 0) AS window_count, coalesce(calls, '') AS calls
FROM hits h LEFT JOIN agg USING (txn_id)""")
def j1(t: Tables):
    return links.coincidences(t.case).select(
        "txn_id", "phone", "account_no", "txn_type", "mode", "amount", "phone_call_records", "phone_contacts",
        "window_count", ids("window_hits", "cdr_id").alias("calls"))


view("near_calls", """
  SELECT DISTINCT p.txn_id, c.cdr_id, c.ts, abs(c.ts - p.ts) AS gap
  FROM pay_phones p JOIN call_ends c ON p.phone = c.phone AND c.ts BETWEEN p.ts - 300 AND p.ts + 300""")
view("near_sessions", """
  SELECT DISTINCT p.txn_id, i.ipdr_id, i.start_ts AS ts
  FROM pay_phones p JOIN f_ipdr i ON p.phone = i.msisdn AND i.start_ts BETWEEN p.ts - 900 AND p.ts + 900""")
view("fused", """
  SELECT b.txn_id AS transaction_id, b.ts, b.date, b.mode, b.txn_type AS direction, b.account_no, b.account_name,
    b.counterparty_name, b.receiver_account, b.sender_phone, b.receiver_phone, b.bank,
    CASE WHEN txn_type = 'C' THEN credit ELSE debit END AS amount,
    coalesce(c.n, 0) AS call_count, coalesce(c.ids, '') AS calls, coalesce(s.n, 0) AS ipdr_count,
    coalesce(s.ids, '') AS sessions, b.account_no IN (SELECT account_no FROM f_complaint) AS complained
  FROM f_bank b
  LEFT JOIN (SELECT txn_id, count(*) AS n, string_agg(CASE WHEN k <= 10 THEN cdr_id END, ',' ORDER BY k) AS ids FROM (
      SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY ts, cdr_id) AS k FROM near_calls) GROUP BY txn_id) c USING (txn_id)
  LEFT JOIN (SELECT txn_id, count(*) AS n, string_agg(CASE WHEN k <= 10 THEN ipdr_id END, ',' ORDER BY k) AS ids FROM (
      SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY ts, ipdr_id) AS k FROM near_sessions) GROUP BY txn_id) s USING (txn_id)""")


@entry("j2_fused_rows", """
SELECT transaction_id, ts, mode, direction, account_no, amount, call_count, calls, ipdr_count, sessions, complained
FROM fused""")
def j2(t: Tables):
    return links.fused_rows(t.case).select(
        "transaction_id", "ts", "mode", "direction", "account_no", "amount", "call_count",
        ids("linked_calls", "cdr_id").alias("calls"), "ipdr_count", ids("linked_sessions", "ipdr_id").alias("sessions"),
        "complained")


@entry("p8_fused_filter", """
SELECT transaction_id, ts, account_no, mode, amount, call_count FROM fused
WHERE mode ILIKE '%upi%' AND date >= '2024-01-01' AND date <= '2024-01-01' AND amount >= 5000 AND amount <= 400000
  AND lower(transaction_id || ' ' || account_no || ' ' || account_name || ' ' || coalesce(counterparty_name, '') || ' '
   || receiver_account || ' ' || sender_phone || ' ' || receiver_phone || ' ' || bank) LIKE '%axis%'""")
def p8(t: Tables):
    rows = links.fused_filter(links.fused_rows(t.case), q="Axis", mode="upi", date_start="2024-01-01",
                              date_end="2024-01-01", min_amount=5000, max_amount=400000)
    return rows.select("transaction_id", "ts", "account_no", "mode", "amount", "call_count")


@entry("k4_fused_page", """
SELECT transaction_id, ts, amount, call_count, ipdr_count, complained FROM fused
ORDER BY ts DESC NULLS LAST, transaction_id LIMIT 100 OFFSET 50""")
def k4(t: Tables):
    return links.fused_page(links.fused_rows(t.case), 50, 100).select(
        "transaction_id", "ts", "amount", "call_count", "ipdr_count", "complained")


view("bank_links", "SELECT txn_id, cdr_id, min(gap) AS time_diff FROM near_calls GROUP BY txn_id, cdr_id")


@entry("j3_bank_call_links", "SELECT txn_id, cdr_id, time_diff FROM bank_links")
def j3(t: Tables):
    return links.bank_call_links(t.case)


view("session_links", """
  SELECT c.cdr_id, i.ipdr_id, k.key, abs(c.ts - i.start_ts) AS time_diff
  FROM (SELECT DISTINCT ipdr_id, start_ts, key FROM (SELECT ipdr_id, start_ts, unnest([imsi, imei, msisdn]) AS key FROM f_ipdr)) i
  JOIN (SELECT DISTINCT cdr_id, ts, key FROM (SELECT cdr_id, ts, unnest([imsi, imei]) AS key FROM f_cdr)) c ON c.key = i.key
  JOIN (SELECT 1 AS one) d ON true JOIN LATERAL (SELECT i.key) k(key) ON true
  WHERE c.ts BETWEEN i.start_ts - 900 AND i.start_ts + 900""")


@entry("j4_call_session_links", "SELECT cdr_id, ipdr_id, key, time_diff FROM session_links")
def j4(t: Tables):
    return links.call_session_links(t.case)


@entry("j5_pair_sets", """
SELECT 'bank_cdr' AS kind, w AS window_sec, count(*) AS pairs FROM (
  SELECT DISTINCT w, p.txn_id, c.cdr_id FROM pay_phones p JOIN call_ends c ON p.phone = c.phone
  JOIN (SELECT unnest([300, 900]) AS w) ON abs(c.ts - p.ts) <= w) GROUP BY w
UNION ALL
SELECT 'cdr_ipdr', w, count(*) FROM (SELECT DISTINCT w, cdr_id, ipdr_id FROM session_links
  JOIN (SELECT unnest([300, 900]) AS w) ON time_diff <= w) GROUP BY w""")
def j5(t: Tables):
    counts = {"bank_cdr": links.bank_call_pair_counts(t.case, (300, 900)), "cdr_ipdr": links.call_session_pair_counts(t.case, (300, 900))}
    one, two = (n.select(F.lit(kind).alias("kind"), "window_sec", "pairs") for kind, n in counts.items())
    return one.unionByName(two)


view("tl", """
  SELECT ts, 'bank' AS kind, txn_id AS record_id, account_no AS entity, left(narration, 80) AS label,
    coalesce(nullif(credit, 0), debit) AS amount, txn_type AS direction, mode, receiver_phone AS phone FROM f_bank
  UNION ALL SELECT ts, 'cdr', cdr_id, a_number, call_type || ' ' || b_number, NULL, call_type, service_type, b_number FROM f_cdr
  UNION ALL SELECT start_ts, 'ipdr', ipdr_id, msisdn, source_ip, NULL, NULL, 'IPDR', msisdn FROM f_ipdr""")


@entry("u1_timeline", """
SELECT ts, kind, record_id, entity, label, coalesce(amount, 0) AS amount, coalesce(direction, '') AS direction, mode, phone
FROM tl""")
def u1(t: Tables):
    return links.timeline(t.case).select(
        "ts", "kind", "record_id", "entity", "label", F.coalesce("amount", F.lit(0.0)).alias("amount"),
        F.coalesce("direction", F.lit("")).alias("direction"), "mode", "phone")


@entry("k1_timeline_sorted", """
SELECT ts, kind, record_id FROM tl ORDER BY ts, kind, record_id""")
def k1(t: Tables):
    return links.timeline(t.case).select("ts", "kind", "record_id").orderBy("ts", "kind", "record_id")


@entry("p7_timeline_filter", """
SELECT ts, record_id, entity FROM tl WHERE kind = 'cdr' AND ts BETWEEN 1704080000 AND 1704200000
ORDER BY ts, record_id LIMIT 200""")
def p7(t: Tables):
    return links.timeline_slice(links.timeline(t.case), "cdr", 1704080000, 1704200000, 200).select(
        "ts", "record_id", "entity")


view("around", """
  SELECT ts, kind AS near_kind, record_id AS near_id, gap, row_number() OVER (PARTITION BY ts ORDER BY gap, kind, record_id) AS rank
  FROM (SELECT m.ts, e.kind, e.record_id, abs(e.ts - m.ts) AS gap,
          row_number() OVER (PARTITION BY m.ts, e.kind ORDER BY e.ts, e.record_id) AS n
        FROM (SELECT DISTINCT ts FROM tl) m JOIN tl e ON e.ts BETWEEN m.ts - 1800 AND m.ts + 1800)
  WHERE n <= 20 AND gap > 0 QUALIFY rank <= 25""")


@entry("j6_events_around", """
SELECT e.kind, e.record_id, a.rank, a.gap, a.near_kind, a.near_id FROM tl e JOIN around a USING (ts)""")
def j6(t: Tables):
    return links.events_around(links.timeline(t.case)).select(
        "kind", "record_id", "rank", "gap", "near_kind", "near_id")


@entry("j7_complaint_flag", """
SELECT txn_id, account_no, account_no IN (SELECT account_no FROM f_complaint) AS complained,
  CASE WHEN account_no IN (SELECT account_no FROM f_complaint) THEN 60 ELSE 0 END AS boost FROM f_bank""")
def j7(t: Tables):
    return links.with_complaint_flag(t.bank.select("txn_id", "account_no"), t.complaints).withColumn(
        "boost", F.when(F.col("complained"), 60).otherwise(0))


@entry("j8_payment_timeline", """
SELECT txn_id, n AS pos, kind, event_ts, ref, detail FROM (
  SELECT b.txn_id, e.kind, e.ts AS event_ts, e.ref, e.detail, row_number() OVER (PARTITION BY b.txn_id ORDER BY e.ts, e.ref) AS n
  FROM f_bank b JOIN (
    SELECT DISTINCT phone, 'call' AS kind, cdr_id AS ref, c.ts, d.a_number || ' -> ' || d.b_number || ' (' || d.duration_sec || 's)' AS detail
    FROM call_ends c JOIN f_cdr d USING (cdr_id)
    UNION ALL SELECT msisdn, 'session', ipdr_id, start_ts, msisdn || ' @ ' || source_ip FROM f_ipdr) e
  ON e.phone = b.sender_phone AND e.ts BETWEEN b.ts - 3600 AND b.ts + 3600) WHERE n <= 12""")
def j8(t: Tables):
    return links.payment_timeline(t.case)


@entry("j9_payment_neighbours", """
SELECT txn_id, n, other_id, other_amount, other_ts FROM (
  SELECT a.txn_id, b.txn_id AS other_id, b.amount AS other_amount, b.ts AS other_ts,
    row_number() OVER (PARTITION BY a.txn_id ORDER BY b.ts, b.txn_id) AS n
  FROM f_bank a JOIN f_bank b ON a.customer_id = b.customer_id AND b.ts BETWEEN a.ts - 3600 AND a.ts + 3600
   AND a.txn_id <> b.txn_id) WHERE n <= 6""")
def j9(t: Tables):
    return links.payment_neighbours(t.bank)


@entry("j10_relationship_links", """
WITH s AS (SELECT * FROM f_bank ORDER BY amount DESC, txn_id LIMIT 200),
r AS (
  SELECT least(a.txn_id, b.txn_id) AS source, greatest(a.txn_id, b.txn_id) AS target, 1 AS o, 'money' AS kind
    FROM s a JOIN s b ON a.receiver_account = b.account_no AND a.txn_id <> b.txn_id
  UNION ALL SELECT a.txn_id, b.txn_id, 2, 'shared' FROM s a JOIN s b ON a.account_no = b.account_no AND a.txn_id < b.txn_id
  UNION ALL SELECT a.txn_id, b.txn_id, 3, 'shared' FROM s a JOIN s b ON a.sender_phone = b.sender_phone AND a.txn_id < b.txn_id
  UNION ALL SELECT a.txn_id, b.txn_id, 4, 'time' FROM s a JOIN s b ON abs(a.ts - b.ts) <= 1800 AND a.txn_id < b.txn_id)
SELECT source, target, string_agg(kind, ',' ORDER BY o) AS kinds, count(*) AS strength FROM r GROUP BY source, target""")
def j10(t: Tables):
    top = t.bank.orderBy(F.desc("amount"), "txn_id").limit(200)
    return links.relationship_links(top).select("source", "target", F.array_join("kinds", JOIN).alias("kinds"), "strength")


@entry("j10_relationship_links_alert_feed")
def j10b(t: Tables):
    """The selection is the whole alert feed, which grows with the table."""
    feed = cut(cp.alert_feed(scored(t), t.case, limit=None).select(F.col("transaction_id").alias("txn_id")))
    return links.relationship_links(cut(t.bank.join(feed, "txn_id", "left_semi"))).select("source", "target", F.array_join("kinds", JOIN).alias("kinds"), "strength")


view("in_out", """
  SELECT * FROM (SELECT c.account_no, c.txn_id AS in_txn, d.txn_id AS out_txn, c.credit AS in_amount, d.debit AS out_amount,
    c.ts AS in_ts, d.ts AS out_ts, d.ts - c.ts AS latency, row_number() OVER (PARTITION BY c.txn_id ORDER BY d.ts, d.txn_id) AS n
  FROM f_bank c JOIN f_bank d ON c.account_no = d.account_no AND c.credit > 0 AND d.debit > 0 AND d.ts > c.ts
    AND d.ts <= c.ts + 900 AND d.debit >= 0.95 * c.credit) WHERE n = 1""")


@entry("j11_rapid_in_out", """
SELECT account_no, in_txn, out_txn, in_amount, out_amount, latency FROM in_out ORDER BY latency, in_txn LIMIT 100""")
def j11(t: Tables):
    return links.rapid_in_out(t.bank).select("account_no", "in_txn", "out_txn", "in_amount", "out_amount", "latency")


view("device_peers", """
  SELECT phone, other, records, row_number() OVER (PARTITION BY phone ORDER BY records DESC, other) AS rank FROM (
    SELECT a.phone, b.phone AS other, sum(b.records) AS records
    FROM (SELECT DISTINCT imei, a_number AS phone FROM f_cdr) a
    JOIN (SELECT imei, a_number AS phone, count(*) AS records FROM f_cdr GROUP BY ALL) b
      ON a.imei = b.imei AND a.phone <> b.phone GROUP BY a.phone, b.phone) QUALIFY rank <= 10""")


@entry("j12_shared_device_phones", "SELECT phone, other, CAST(records AS BIGINT) AS records, rank FROM device_peers")
def j12(t: Tables):
    return links.shared_device_phones(t.cdr).select("phone", "other", "records", "rank")


@entry("j13_investigation_calls", """
WITH sus AS (SELECT * FROM f_bank WHERE amount >= 1000 AND CAST(amount AS BIGINT) % 5000 = 0 AND debit > 0),
risky AS (SELECT DISTINCT mobile AS phone FROM f_complaint),
sp AS (SELECT txn_id, ts, sender_phone AS phone FROM sus UNION SELECT txn_id, ts, receiver_phone FROM sus),
ends AS (SELECT DISTINCT cdr_id, ts, phone FROM call_ends),
n AS (SELECT e.cdr_id, count(*) AS near_payments FROM ends e JOIN sp ON e.phone = sp.phone AND sp.ts BETWEEN e.ts - 3600 AND e.ts + 3600 GROUP BY 1),
r AS (SELECT cdr_id, string_agg(phone, ', ' ORDER BY phone) AS phones FROM ends JOIN risky USING (phone) GROUP BY 1)
SELECT c.cdr_id, a_number, b_number, coalesce(near_payments, 0) AS near_payments,
  concat_ws('; ', 'high-risk phone ' || phones, near_payments || ' suspicious payment(s) within 60 min') AS evidence
FROM f_cdr c LEFT JOIN n USING (cdr_id) LEFT JOIN r USING (cdr_id) WHERE near_payments IS NOT NULL OR phones IS NOT NULL""")
def j13(t: Tables):
    suspicious = t.bank.where("debit > 0 and amount >= 1000 and amount % 5000 = 0")
    risky = t.complaints.select(F.col("mobile").alias("phone"))
    return links.investigation_calls(t.case, suspicious, risky).select(
        "cdr_id", "a_number", "b_number", "near_payments", F.array_join("evidence", "; ").alias("evidence"))


@entry("j14_missing_links", """
SELECT * FROM (SELECT 'no_call_records' AS gap, phone FROM (SELECT sender_phone AS phone FROM f_bank UNION SELECT receiver_phone FROM f_bank)
  WHERE phone NOT IN (SELECT a_number FROM f_cdr) ORDER BY phone LIMIT 10)
UNION ALL
SELECT * FROM (SELECT 'no_data_sessions', a_number FROM (SELECT DISTINCT a_number FROM f_cdr)
  WHERE a_number NOT IN (SELECT msisdn FROM f_ipdr) ORDER BY 2 LIMIT 10)""")
def j14(t: Tables):
    return links.missing_links(t.case)


@entry("j15_finding_hits", """
WITH f AS (SELECT complaint_id AS finding_id, 'Complaint on account ' || account_no || ' and others' AS title FROM f_complaint)
SELECT finding_id, title, txn_id AS transaction_id, account_no, amount AS risk_score FROM f
JOIN f_bank ON contains(title, txn_id) OR contains(title, account_no)""")
def j15(t: Tables):
    findings = t.complaints.select(F.col("complaint_id").alias("finding_id"), F.concat(
        F.lit("Complaint on account "), "account_no", F.lit(" and others")).alias("title"))
    scored = t.bank.select(F.col("txn_id").alias("transaction_id"), "account_no", F.col("amount").alias("risk_score"))
    return links.finding_hits(findings, scored)


view("pay_sessions", """
  SELECT b.txn_id, b.account_no, l.cdr_id, c.imei AS call_imei, c.imsi AS call_imsi, s.ipdr_id, i.source_ip, i.imei AS session_imei
  FROM f_bank b LEFT JOIN bank_links l USING (txn_id) LEFT JOIN f_cdr c ON c.cdr_id = l.cdr_id
  LEFT JOIN (SELECT DISTINCT cdr_id, ipdr_id FROM session_links) s ON s.cdr_id = l.cdr_id
  LEFT JOIN f_ipdr i ON i.ipdr_id = s.ipdr_id""")


@entry("j16_payment_sessions", """
SELECT txn_id, account_no, coalesce(cdr_id, '') AS cdr_id, coalesce(call_imei, '') AS call_imei,
  coalesce(ipdr_id, '') AS ipdr_id, coalesce(source_ip, '') AS source_ip FROM pay_sessions""")
def j16(t: Tables):
    blank = F.lit("")
    return links.payment_sessions(t.case).select("txn_id", "account_no", *[F.coalesce(c, blank).alias(c) for c in (
        "cdr_id", "call_imei", "ipdr_id", "source_ip")])


view("legs", """
  SELECT txn_id, date, date || ' ' || time AS timestamp, narration, mode, amount, customer_id AS sender_customer_id,
    account_name AS sender_name, bank AS sender_bank,
    CASE WHEN txn_type = 'C' THEN receiver_account ELSE account_no END AS sender_account,
    CASE WHEN txn_type = 'C' THEN account_no ELSE receiver_account END AS receiver_account,
    sender_phone, receiver_phone, counterparty_name AS receiver_name, counterparty_bank AS receiver_bank, ts FROM f_bank""")


@entry("j17_complaint_payments", """
SELECT c.complaint_id, c.account_no, c.state, coalesce(l.txn_id, '') AS txn_id, coalesce(l.amount, 0) AS amount
FROM f_complaint c LEFT JOIN legs l ON l.sender_account = c.account_no OR l.receiver_account = c.account_no""")
def j17(t: Tables):
    return links.complaint_payments(t.complaints, bank_legs(t.bank)).select(
        "complaint_id", "account_no", "state", F.coalesce("txn_id", F.lit("")).alias("txn_id"),
        F.coalesce("amount", F.lit(0.0)).alias("amount"))


@entry("j19_coverage", """
SELECT 'bank' AS dataset, count(*) AS total, count(*) FILTER (WHERE 'T' || event_id IN (SELECT txn_id FROM f_bank)) AS matched FROM events
UNION ALL SELECT 'cdr', count(*), count(*) FILTER (WHERE 'C' || event_id IN (SELECT cdr_id FROM f_cdr)) FROM events
UNION ALL SELECT 'ipdr', count(*), count(*) FILTER (WHERE 'I' || event_id IN (SELECT ipdr_id FROM f_ipdr)) FROM events""")
def j19(t: Tables):
    from weftline.plans.validation import id_coverage
    e = t.read("events")
    out = None
    for name, prefix, have in (("bank", "T", t.bank.select("txn_id")), ("cdr", "C", t.cdr.select("cdr_id")),
                               ("ipdr", "I", t.ipdr.select("ipdr_id"))):
        want = e.select(F.concat(F.lit(prefix), F.col("event_id").cast("string")).alias("id"))
        one = id_coverage(want, have.toDF("id")).select(F.lit(name).alias("dataset"), "total", "matched")
        out = one if out is None else out.unionByName(one)
    return out


@entry("j20_vertex_names", """
SELECT v.id, coalesce(h.holder, s.subscriber_name, '') AS label, coalesce(h.phone, s.msisdn, '') AS phone FROM (
  SELECT account_no AS id FROM f_bank UNION SELECT receiver_account FROM f_bank UNION SELECT sender_phone FROM f_bank) v
LEFT JOIN (SELECT account_no, arg_min(account_name, (ts, txn_id)) AS holder, arg_min(sender_phone, (ts, txn_id)) AS phone
  FROM f_bank GROUP BY 1) h ON h.account_no = v.id
LEFT JOIN f_sub s ON s.msisdn = v.id""")
def j20(t: Tables):
    v = t.bank.select(F.explode(F.array("account_no", "receiver_account", "sender_phone")).alias("id")).distinct()
    return links.fill_names(v, t.bank, t.subscribers).select(
        "id", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("phone", F.lit("")).alias("phone"))


@entry("p13_quick_risk", """
SELECT transaction_id, least(100, CASE WHEN complained THEN 40 ELSE 0 END + CASE WHEN call_count > 0 THEN 20 ELSE 0 END
  + CASE WHEN ipdr_count > 0 THEN 10 ELSE 0 END + CASE WHEN amount >= 100000 THEN 15 ELSE 0 END) AS quick_risk FROM fused""")
def p13(t: Tables):
    return links.quick_risk(links.fused_rows(t.case))


@entry("u4_telecom_overlap", """
SELECT (SELECT count(*) FROM (SELECT a_number FROM f_cdr INTERSECT SELECT msisdn FROM f_ipdr)) AS both_sides,
  (SELECT count(*) FROM (SELECT a_number FROM f_cdr UNION SELECT msisdn FROM f_ipdr)) AS either_side""")
def u4(t: Tables):
    a, b = t.cdr.select("a_number"), t.ipdr.select("msisdn")
    both = a.intersect(b).agg(F.count(F.lit(1)).alias("n")).select(F.lit("both_sides").alias("k"), "n")
    either = a.union(b).distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("either_side").alias("k"), "n")
    return both.unionByName(either).groupBy().pivot("k", ["both_sides", "either_side"]).agg(F.first("n"))


@entry("u2_first_by_id", """
SELECT txn_id, min(account_no) AS account_no, 1 AS copy, count(*) AS records FROM f_bank GROUP BY 1""")
def u2(t: Tables):
    from weftline.operators.views import keep_first
    # every payment met three times, as when a folder holds the same export more than once
    copies = t.bank.select("txn_id", "account_no", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("copy"))
    return keep_first(copies, ["txn_id"], ["copy"]).select("txn_id", "account_no", "copy", F.lit(1).cast("long").alias("records"))
