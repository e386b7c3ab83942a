"""Cards, patterns, records, dossiers, receivers and journeys of every entity."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, entry, rounded, view
from weftline.operators import links
from weftline.plans import dossier as ds

_PAY = """'bank' AS tab, txn_id AS record_id, ts, concat_ws(' ', txn_type, mode, left(narration, 70)) AS label, credit, debit,
  coalesce(nullif(credit, 0), debit, 0) AS amount, receiver_account AS receiver, FALSE AS sms FROM f_bank"""
_CALL = "'cdr', cdr_id, ts, concat_ws(' ', call_type, 'to', b_number, duration_sec || 's'), NULL, NULL, NULL, NULL, contains(upper(call_type), 'SMS') FROM f_cdr"
_SESSION = "'ipdr', ipdr_id, start_ts, concat_ws(' ', 'session', source_ip, 'to', dest_ip, duration_sec || 's'), NULL, NULL, NULL, NULL, FALSE FROM f_ipdr"
view("posts", f"""
  SELECT 'account' AS kind, account_no AS value, TRUE AS own, {_PAY}
  UNION ALL SELECT 'account', receiver_account, FALSE, {_PAY} WHERE receiver_account <> account_no
  UNION ALL SELECT 'phone', sender_phone, TRUE, {_PAY}
  UNION ALL SELECT 'phone', receiver_phone, TRUE, {_PAY} WHERE receiver_phone <> sender_phone
  UNION ALL SELECT 'upi', upi_id, TRUE, {_PAY} WHERE upi_id IS NOT NULL
  UNION ALL SELECT 'name', lower(counterparty_name), TRUE, {_PAY} WHERE counterparty_name IS NOT NULL
  UNION ALL SELECT 'phone', a_number, TRUE, {_CALL}
  UNION ALL SELECT 'phone', b_number, FALSE, {_CALL} WHERE b_number <> a_number
  UNION ALL SELECT 'imei', imei, TRUE, {_CALL} UNION ALL SELECT 'imsi', imsi, TRUE, {_CALL}
  UNION ALL SELECT 'phone', msisdn, TRUE, {_SESSION} UNION ALL SELECT 'imei', imei, TRUE, {_SESSION}
  UNION ALL SELECT 'imsi', imsi, TRUE, {_SESSION} UNION ALL SELECT 'ip', source_ip, TRUE, {_SESSION}""")
view("named", """
  SELECT 'bank' AS tab, txn_id AS record_id, 'accounts' AS link, account_no AS target FROM f_bank
  UNION SELECT 'bank', txn_id, 'receivers', receiver_account FROM f_bank UNION SELECT 'bank', txn_id, 'phones', sender_phone FROM f_bank
  UNION SELECT 'bank', txn_id, 'phones', receiver_phone FROM f_bank UNION SELECT 'bank', txn_id, 'upi_ids', upi_id FROM f_bank WHERE upi_id IS NOT NULL
  UNION SELECT 'bank', txn_id, 'names', counterparty_name FROM f_bank WHERE counterparty_name IS NOT NULL
  UNION SELECT 'cdr', cdr_id, 'phones', a_number FROM f_cdr UNION SELECT 'cdr', cdr_id, 'phones', b_number FROM f_cdr
  UNION SELECT 'cdr', cdr_id, 'imeis', imei FROM f_cdr UNION SELECT 'cdr', cdr_id, 'towers', cell_id_first FROM f_cdr
  UNION SELECT 'ipdr', ipdr_id, 'phones', msisdn FROM f_ipdr UNION SELECT 'ipdr', ipdr_id, 'imeis', imei FROM f_ipdr
  UNION SELECT 'ipdr', ipdr_id, 'ips', source_ip FROM f_ipdr""")
view("tied", """
  SELECT kind, value, link, target, count(*) AS n, count(*) FILTER (WHERE own) AS own_n FROM posts JOIN named USING (tab, record_id)
  WHERE NOT (lower(target) = lower(value) AND (kind = 'account' AND link IN ('accounts', 'receivers') OR kind || 's' = link OR kind = 'upi' AND link = 'upi_ids')) GROUP BY ALL""")
view("reported", """
  SELECT kind, value, count(*) AS complaints FROM (SELECT 'account' AS kind, account_no AS value FROM f_complaint UNION ALL SELECT 'phone', mobile FROM f_complaint) GROUP BY ALL""")
view("rated", """
  SELECT 'account' AS kind, account_no AS value, score, flags FROM acc_heat
  UNION ALL SELECT 'phone', phone, score, concat_ws(',', CASE WHEN records >= 50 THEN 'HIGH_ACTIVITY' END, CASE WHEN unique_contacts >= 25 THEN 'MANY_CONTACTS' END,
    CASE WHEN last_ts - first_ts > 5184000 THEN 'LONG_ACTIVITY_SPAN' END) FROM phone_prof JOIN ph_heat USING (phone, records, unique_contacts)""")


def _listed(columns: tuple[str, ...], source: str) -> str:
    lists = ", ".join(f"coalesce(string_agg(target, ',' ORDER BY place) FILTER (WHERE link = '{c}'), '') AS {c}" for c in columns)
    counts = ", ".join(f"count(*) FILTER (WHERE link = '{c}') AS n_{c}" for c in columns)
    shown = lists.replace("FILTER (WHERE link", "FILTER (WHERE place <= most AND link")
    return f"SELECT kind, value, {shown}, {counts} FROM ({source}) GROUP BY kind, value"


view("card_ties", _listed(ds.CARD_LINKS, "SELECT *, 12 AS most, row_number() OVER (PARTITION BY kind, value, link ORDER BY own_n DESC, target) AS place FROM tied WHERE own_n > 0"))
view("dossier_ties", _listed(ds.DOSSIER_LINKS, "SELECT *, 20 AS most, row_number() OVER (PARTITION BY kind, value, link ORDER BY target) AS place FROM tied"))


def _flat(df):
    """Arrays of strings as one text each, so that they compare like other columns."""
    return df.select(*[F.array_join(c, ",").alias(c) if kind == "array<string>" else F.col(c) for c, kind in df.dtypes])


@entry("c1_cards_complete", f"""
SELECT p.*, coalesce(score, 0) AS score, coalesce(flags, '') AS flags, coalesce(complaints, 0) AS complaints, {", ".join(f"coalesce({c}, '') AS {c}" for c in ds.CARD_LINKS)}
FROM (SELECT kind, value, count(*) FILTER (WHERE tab = 'bank') AS transactions, count(*) FILTER (WHERE tab = 'cdr' AND NOT sms) AS calls, count(*) FILTER (WHERE tab = 'cdr' AND sms) AS sms,
    count(*) FILTER (WHERE tab = 'ipdr') AS ip_sessions, coalesce(sum(credit), 0) AS credit, coalesce(sum(debit), 0) AS debit, coalesce(round(avg(amount), 2), 0) AS avg_amount,
    coalesce(max(amount), 0) AS max_amount, count(*) FILTER (WHERE debit >= 1000 AND CAST(debit AS BIGINT) % 5000 = 0) AS round_amounts, min(ts) AS first_ts, max(ts) AS last_ts
  FROM posts WHERE own GROUP BY kind, value) p
LEFT JOIN card_ties USING (kind, value) LEFT JOIN rated USING (kind, value) LEFT JOIN reported USING (kind, value)""")
def c1_cards(t: Tables):
    return _flat(ds.full_cards(t.case))


@entry("c1_card_records", """
SELECT kind, value, tab AS "table", record_id, ts, label, coalesce(amount, 0) AS amount, n FROM (
  SELECT *, row_number() OVER (PARTITION BY kind, value ORDER BY ts DESC, tab, record_id) AS n FROM posts WHERE own) WHERE n <= 15""")
def c1_records(t: Tables):
    return ds.card_records(ds.postings(t.case)).withColumn("amount", F.coalesce("amount", F.lit(0.0)))


@entry("c1_card_patterns", """
WITH near AS (SELECT t.txn_id, account_no, receiver_phone AS phone, count(*) AS k FROM f_bank t JOIN f_cdr c ON t.receiver_phone = c.a_number AND c.ts BETWEEN t.ts - 3600 AND t.ts + 3600 GROUP BY ALL)
SELECT 'account' AS kind, account_no AS value, 'COMPLAINT' AS pattern, count(*) AS hits FROM f_complaint WHERE account_no IN (SELECT account_no FROM f_bank) GROUP BY ALL
UNION ALL SELECT 'account', account_no, 'STRUCTURED_PAYOUTS', count(*) FROM f_bank WHERE debit >= 1000 AND CAST(debit AS BIGINT) % 5000 = 0 GROUP BY ALL
UNION ALL SELECT 'account', account_no, 'RAPID_CASH_OUT', count(*) FROM payouts GROUP BY ALL
UNION ALL SELECT 'account', account_no, 'RAPID_IN_AND_OUT', count(*) FROM in_out GROUP BY ALL
UNION ALL SELECT 'account', account_no, 'CALLS_NEAR_PAYMENTS', count(*) FROM near GROUP BY ALL
UNION ALL SELECT 'phone', phone, 'CALLS_NEAR_PAYMENTS', CAST(sum(k) AS BIGINT) FROM near GROUP BY ALL
UNION ALL SELECT 'phone', value, 'PAYMENTS_AND_CALLS', count(*) FILTER (WHERE tab = 'bank') FROM posts WHERE kind = 'phone' GROUP BY value
  HAVING count(*) FILTER (WHERE tab = 'bank') > 0 AND count(*) FILTER (WHERE tab = 'cdr' AND own) > 0
UNION ALL SELECT 'phone', phone, 'SHARED_DEVICE', count(*) FROM device_peers GROUP BY phone""")
def c1_patterns(t: Tables):
    return ds.card_patterns(t.case, ds.postings(t.case), links.coincidences(t.case))


_N = {c: f"coalesce(n_{c}, 0)" for c in ds.DOSSIER_LINKS}


@entry("c4_dossiers", f"""
WITH c AS (SELECT kind, value, count(*) FILTER (WHERE tab = 'bank') AS transactions, count(*) FILTER (WHERE tab = 'cdr') AS calls, count(*) FILTER (WHERE tab = 'ipdr') AS sessions,
    coalesce(sum(credit) FILTER (WHERE kind = 'account'), 0) AS credits, coalesce(sum(debit) FILTER (WHERE kind = 'account' AND own), 0) AS outflow, coalesce(sum(amount), 0) AS total,
    coalesce(max(amount), 0) AS max_amount, min(ts) AS first_ts, max(ts) AS last_ts FROM posts GROUP BY kind, value),
f AS (SELECT *, CASE WHEN credits = 0 AND outflow = 0 THEN total ELSE credits END AS inflow FROM c),
j AS (SELECT *, inflow + outflow AS turnover, CASE WHEN inflow + outflow > 500000 AND coalesce(score, 0) < 40 THEN 45 ELSE coalesce(score, 0) END AS risk_score
  FROM f LEFT JOIN dossier_ties USING (kind, value) LEFT JOIN rated USING (kind, value) LEFT JOIN reported USING (kind, value))
SELECT kind, value, transactions, calls, sessions, inflow, outflow, turnover, round(turnover / greatest(transactions, 1), 2) AS avg_amount, max_amount, first_ts, last_ts, coalesce(complaints, 0) AS complaints,
  {", ".join(f"{n} AS n_{c}" for c, n in _N.items())}, {_N["receivers"]} + {_N["names"]} + {_N["phones"]} AS peers, {", ".join(f"coalesce({c}, '') AS {c}" for c in ds.DOSSIER_LINKS)},
  risk_score, CASE WHEN risk_score >= 75 THEN 'CRITICAL' WHEN risk_score >= 50 THEN 'HIGH' WHEN risk_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band,
  CASE WHEN coalesce(flags, '') <> '' THEN flags ELSE concat_ws(',', CASE WHEN turnover > 100000 THEN 'HIGH_VALUE_VOLUME' END, CASE WHEN {_N["receivers"]} >= 3 THEN 'DISPERSED_PAYOUTS' END,
    CASE WHEN {_N["phones"]} >= 2 THEN 'SEVERAL_LINES' END) END AS rules, CASE WHEN {_N["receivers"]} >= 3 THEN 'DETECTED' ELSE 'STANDARD' END AS layering FROM j""")
def c4_dossiers(t: Tables):
    return rounded(_flat(ds.dossiers(t.case)))


@entry("c4_dossier_receivers", """
SELECT * FROM (SELECT kind, value, receiver AS receiver_account, sum(amount) AS total_received, count(*) AS payments, row_number() OVER (PARTITION BY kind, value ORDER BY receiver) AS n
  FROM posts WHERE receiver IS NOT NULL AND NOT (kind = 'account' AND receiver = value) GROUP BY kind, value, receiver) WHERE n <= 15""")
def c4_receivers(t: Tables):
    return ds.dossier_receivers(ds.postings(t.case))


@entry("c4_journeys", """
SELECT kind, value, tab AS "table", record_id, ts, '[' || upper(tab) || '] ' || label AS event, step FROM (
  SELECT *, row_number() OVER (PARTITION BY kind, value ORDER BY ts, tab, record_id) AS step FROM posts) WHERE step <= 60""")
def c4_journeys(t: Tables):
    return ds.journeys(ds.postings(t.case))
