"""Case evidence of the whole alert feed: sequence of funds, network, telecom of the day, all columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, entry, rounded, view
from catalog.dossiers import _flat
from catalog.reports import every_alert
from weftline.plans import case_parts as cs

view("feed", "SELECT transaction_id AS txn_id, risk_score FROM alerts WHERE risk_score >= 50")
view("inflow", "SELECT account_no, txn_id, date, time, credit AS amount, coalesce(counterparty_name, receiver_account, 'Unknown') AS entity, row_number() OVER w AS place, sum(credit) OVER w AS run FROM f_bank WHERE credit > 0 WINDOW w AS (PARTITION BY account_no ORDER BY date, time, txn_id ROWS UNBOUNDED PRECEDING)")
view("onward", "SELECT account_no, txn_id, date, time, debit AS amount, coalesce(counterparty_name, receiver_account, 'Unknown') AS entity, row_number() OVER w AS place, sum(debit) OVER w AS run FROM f_bank WHERE debit > 0 WINDOW w AS (PARTITION BY account_no ORDER BY date, time, txn_id ROWS UNBOUNDED PRECEDING)")
view("cases", """
  SELECT b.txn_id, b.account_no, b.receiver_account, coalesce(b.sender_phone, b.receiver_phone) AS phone, (b.ts + 19800) // 86400 AS day, b.amount, b.date, b.time,
    coalesce(i.n, 0) AS n, coalesce(i.s, 0) AS came FROM feed JOIN f_bank b USING (txn_id)
  LEFT JOIN (SELECT account_no, count(*) AS n, sum(amount) AS s FROM inflow GROUP BY 1) i USING (account_no)""")


def feed(t: Tables):
    return every_alert(t).withColumnRenamed("transaction_id", "txn_id")


@entry("c5_fund_sequence", """
SELECT * FROM (
  SELECT c.txn_id, i.place AS step, 'INFLOW' AS direction, i.txn_id AS entry, i.date || ' ' || i.time AS at, i.amount, i.entity, i.run AS balance FROM cases c JOIN inflow i USING (account_no)
  UNION ALL SELECT txn_id, n + 1, 'ALERT', txn_id, date || ' ' || time, amount, account_no || ' > ' || receiver_account, came - amount FROM cases
  UNION ALL SELECT c.txn_id, n + 1 + o.place, 'OUTFLOW', o.txn_id, o.date || ' ' || o.time, o.amount, o.entity, came - c.amount - o.run FROM cases c JOIN onward o ON o.account_no = c.receiver_account)
WHERE step <= 30""")
def c5_sequence(t: Tables):
    found = feed(t)
    return rounded(cs.fund_sequence(t.bank, found))


_NEXT = """SELECT account_no, other, max(pays) AS pays FROM (SELECT account_no, coalesce(receiver_account, counterparty_name) AS other, 0 AS pays FROM f_bank
    UNION ALL SELECT receiver_account, account_no, 1 FROM f_bank) WHERE other IS NOT NULL GROUP BY ALL"""
view("neighbours", f"""
  SELECT account_no, count(*) AS connected, CAST(sum(pays) AS BIGINT) AS payers, string_agg(other, ',' ORDER BY other) FILTER (WHERE place <= 20) AS neighbours
  FROM (SELECT *, row_number() OVER (PARTITION BY account_no ORDER BY other) AS place FROM ({_NEXT})) GROUP BY 1""")


@entry("c5_alert_network", "SELECT txn_id, account_no, connected, payers, neighbours FROM cases JOIN neighbours USING (account_no)")
def c5_network(t: Tables):
    return _flat(cs.alert_network(t.bank, feed(t)))


view("day_calls", """
  SELECT phone, day, count(*) AS n, string_agg(cdr_id, ',' ORDER BY place) FILTER (WHERE place <= 20) AS ids FROM (
    SELECT phone, day, cdr_id, row_number() OVER (PARTITION BY phone, day ORDER BY ts, cdr_id) AS place FROM (SELECT DISTINCT phone, (ts + 19800) // 86400 AS day, ts, cdr_id FROM call_ends)) GROUP BY ALL""")
view("day_sessions", """
  SELECT phone, day, count(*) AS n, string_agg(ipdr_id, ',' ORDER BY place) FILTER (WHERE place <= 15) AS ids FROM (
    SELECT msisdn AS phone, (start_ts + 19800) // 86400 AS day, ipdr_id, row_number() OVER (PARTITION BY msisdn, (start_ts + 19800) // 86400 ORDER BY start_ts, ipdr_id) AS place FROM f_ipdr) GROUP BY ALL""")


def _shared(column: str) -> str:
    return f"""SELECT phone, count(*) AS n, string_agg(v, ',' ORDER BY v) FILTER (WHERE place <= 20) AS ids FROM (SELECT phone, v, row_number() OVER (PARTITION BY phone ORDER BY v) AS place FROM (
      SELECT DISTINCT msisdn AS phone, {column} AS v FROM f_ipdr WHERE {column} IN (SELECT {column} FROM f_ipdr GROUP BY 1 HAVING count(DISTINCT msisdn) > 1))) GROUP BY 1"""


view("kin_devices", _shared("imei"))
view("kin_addresses", _shared("source_ip"))
view("day_telecom", """
  SELECT c.txn_id, c.phone, coalesce(a.n, 0) AS n_calls, coalesce(s.n, 0) AS n_sessions, coalesce(d.n, 0) AS n_devices, coalesce(i.n, 0) AS n_addresses,
    coalesce(a.ids, '') AS calls, coalesce(s.ids, '') AS sessions, coalesce(d.ids, '') AS devices, coalesce(i.ids, '') AS addresses
  FROM cases c LEFT JOIN day_calls a ON a.phone = c.phone AND a.day = c.day LEFT JOIN day_sessions s ON s.phone = c.phone AND s.day = c.day
  LEFT JOIN kin_devices d ON d.phone = c.phone LEFT JOIN kin_addresses i ON i.phone = c.phone""")


@entry("c5_telecom_of_day", "SELECT * FROM day_telecom")
def c5_telecom(t: Tables):
    return _flat(cs.telecom_of_day(t.case, feed(t)))


@entry("c5_case_evidence", """
SELECT txn_id, upper(left(sha256(txn_id), 8)) AS case_code, round(least(f.risk_score, 100), 1) AS risk_score, w.account_no, w.receiver_account, w.amount, inflows, total_inflow, outflows, total_outflow, retention_pct,
  w.account_no IN (SELECT account_no FROM f_complaint) AS complained, CASE WHEN m.n >= 2 THEN round(med, 2) ELSE 0 END AS median, CASE WHEN m.n >= 2 AND med > 0 THEN round(w.amount / med, 1) ELSE 0 END AS deviation_ratio,
  CASE WHEN m.n >= 2 THEN m.n ELSE 0 END AS history, CASE WHEN m.n >= 2 THEN round((SELECT count(*) FROM f_bank x WHERE x.account_no = w.account_no AND x.amount <= w.amount) * 100e0 / m.n, 1) ELSE 0 END AS percentile,
  CAST(coalesce((SELECT sum(d) FROM sdev JOIN pay_phones p USING (phone) WHERE p.txn_id = w.txn_id), 0) AS BIGINT) AS shared_devices, 4 AS fields_present, coalesce(k, 0) AS calls_on_day, connected, payers, neighbours, t.* EXCLUDE (txn_id),
  (SELECT count(*) FROM f_bank) AS bank_records, (SELECT count(*) FROM f_cdr) AS cdr_records, (SELECT count(*) FROM f_ipdr) AS ipdr_records, (SELECT count(*) FROM f_complaint) AS complaint_records, '' AS missing
FROM feed f JOIN fflow USING (txn_id) JOIN cases w USING (txn_id) JOIN day_telecom t USING (txn_id) JOIN neighbours b ON b.account_no = w.account_no
JOIN (SELECT account_no, median(amount) AS med, count(*) AS n FROM f_bank GROUP BY 1) m ON m.account_no = w.account_no LEFT JOIN dayk USING (txn_id)""")
def c5_case(t: Tables):
    j = _flat(cs.whole_case(t.case, every_alert(t)))
    z = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    apart = ("median", "deviation_ratio", "percentile", "history", "risk_score")
    return j.select(*[c for c in j.columns if c not in apart], F.round("risk_score", 1).alias("risk_score"), z("median"), z("deviation_ratio"), z("percentile"), F.coalesce("history", F.lit(0)).alias("history"))
