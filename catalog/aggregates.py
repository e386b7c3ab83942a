"""Profiles, registries and report aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, entry, rounded, view
from weftline.operators import aggregates as ag
from weftline.operators import links
from weftline.plans import rules


def counts(col):
    """``value:count`` text of a top-k map in rank order."""
    return F.coalesce(F.array_join(F.transform(F.map_entries(col), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ","), F.lit(""))


def _top(key: str, value: str, src: str, k: int, out: str) -> str:
    return (f"SELECT {key} AS key, string_agg(v || ':' || n, ',' ORDER BY r) AS {out} FROM (SELECT {key}, v, n, "
            f"row_number() OVER (PARTITION BY {key} ORDER BY n DESC, v) AS r FROM (SELECT {key}, {value} AS v, count(*) AS n FROM {src} "
            f"WHERE {value} IS NOT NULL GROUP BY ALL)) WHERE r <= {k} GROUP BY 1")


view("phone_prof", f"""
  SELECT phone, records, unique_contacts, sms, voice, first_ts, last_ts, towers FROM (
    SELECT a_number AS phone, count(*) AS records, count(DISTINCT b_number) AS unique_contacts,
      count(*) FILTER (WHERE call_type LIKE '%SMS%') AS sms, count(*) FILTER (WHERE call_type NOT LIKE '%SMS%') AS voice,
      min(ts) AS first_ts, max(ts) AS last_ts FROM f_cdr GROUP BY 1)
  JOIN ({_top('a_number', 'cell_id_first', 'f_cdr', 5, 'towers')}) ON key = phone""")


@entry("a1_phone_profiles", "SELECT * FROM phone_prof")
def a1(t: Tables):
    return ag.phone_profiles(t.cdr).join(ag.phone_towers(t.cdr), "phone").withColumn("towers", counts("towers"))


@entry("a2_account_profiles", f"""
SELECT c.*, m.modes, coalesce(n.counterparties, '') AS counterparties, p.phones, coalesce(u.upi_ids, '') AS upi_ids,
  coalesce(x.n, 0) AS complaints, coalesce(x.states, '') AS states FROM (
  SELECT account_no, min(bank) AS bank, count(*) AS txns, coalesce(sum(credit), 0) AS credit, coalesce(sum(debit), 0) AS debit,
    min(ts) AS first_ts, max(ts) AS last_ts FROM f_bank GROUP BY 1) c
LEFT JOIN ({_top('account_no', 'mode', 'f_bank', 6, 'modes')}) m ON m.key = account_no
LEFT JOIN ({_top('account_no', 'counterparty_name', 'f_bank', 8, 'counterparties')}) n ON n.key = account_no
LEFT JOIN ({_top('account_no', 'receiver_phone', 'f_bank', 8, 'phones')}) p ON p.key = account_no
LEFT JOIN ({_top('account_no', 'upi_id', 'f_bank', 8, 'upi_ids')}) u ON u.key = account_no
LEFT JOIN (SELECT account_no, count(*) AS n, string_agg(DISTINCT state, ',' ORDER BY state) AS states FROM f_complaint GROUP BY 1) x USING (account_no)""")
def a2(t: Tables):
    a = ag.account_profiles(t.bank, t.complaints)
    return a.withColumns({c: counts(c) for c in ("modes", "counterparties", "phones", "upi_ids")}).withColumn(
        "states", F.coalesce(F.array_join("states", ","), F.lit("")))


view("registry", """
  SELECT kind, value, CAST(sum(CASE WHEN kind = 'account' AND role = 'complaint' THEN 0 ELSE n END) AS BIGINT) AS count,
    string_agg(role || '/' || source || ':' || n, ',' ORDER BY role, source) AS roles FROM (
    SELECT kind, value, role, source, count(*) AS n FROM (
      SELECT 'account' AS kind, account_no AS value, 'account' AS role, 'bank' AS source FROM f_bank
      UNION ALL SELECT 'account', account_no, 'complaint', 'complaint' FROM f_complaint
      UNION ALL SELECT 'phone', sender_phone, 'bank_sender', 'bank' FROM f_bank UNION ALL SELECT 'phone', receiver_phone, 'bank_receiver', 'bank' FROM f_bank
      UNION ALL SELECT 'phone', a_number, 'cdr_a', 'cdr' FROM f_cdr UNION ALL SELECT 'phone', b_number, 'cdr_b', 'cdr' FROM f_cdr
      UNION ALL SELECT 'phone', msisdn, 'ipdr', 'ipdr' FROM f_ipdr UNION ALL SELECT 'phone', msisdn, 'subscriber', 'subscriber' FROM f_sub
      UNION ALL SELECT 'phone', mobile, 'complaint_mobile', 'complaint' FROM f_complaint
      UNION ALL SELECT 'upi', upi_id, 'upi', 'bank' FROM f_bank UNION ALL SELECT 'imei', imei, 'imei', 'cdr' FROM f_cdr
      UNION ALL SELECT 'imei', imei, 'imei', 'subscriber' FROM f_sub UNION ALL SELECT 'imsi', imsi, 'imsi', 'cdr' FROM f_cdr
      UNION ALL SELECT 'imsi', imsi, 'imsi', 'subscriber' FROM f_sub UNION ALL SELECT 'ip', source_ip, 'ip', 'ipdr' FROM f_ipdr
      UNION ALL SELECT 'name', lower(counterparty_name), 'name', 'bank' FROM f_bank
      UNION ALL SELECT 'name', lower(subscriber_name), 'name', 'subscriber' FROM f_sub) WHERE value IS NOT NULL GROUP BY ALL) GROUP BY 1, 2""")


@entry("a3_entity_registry", "SELECT * FROM registry")
def a3(t: Tables):
    r = ag.entity_registry(t.case)
    text = F.transform("roles", lambda x: F.concat(x["role"], F.lit("/"), x["source"], F.lit(":"), x["n"].cast("string")))
    return r.select("kind", "value", "count", F.array_join(text, ",").alias("roles"))


@entry("a4_mode_counts", """
SELECT mode, count(*) AS txns, sum(amount) AS amount, list_position(['UPI','IMPS','NEFT','RTGS','ATM','POS','CHEQUE','CASH','MBB','NACH','ECS','OTHER'], mode) AS position
FROM f_bank GROUP BY 1""")
def a4(t: Tables):
    return ag.mode_counts(t.bank)


@entry("a8_account_hour_heatmap", """
SELECT account_no, (ts % 86400) // 3600 AS hour, count(*) AS txns, sum(amount) AS amount FROM f_bank
WHERE account_no IN (SELECT account_no FROM f_bank GROUP BY 1 ORDER BY sum(amount) DESC, account_no LIMIT 30) GROUP BY 1, 2""")
def a8(t: Tables):
    return ag.account_hour_heatmap(t.bank)


@entry("a9_activity_levels", """
WITH b AS (SELECT (ts % 86400) // 3600 AS hour, (ts // 86400 + 3) % 7 AS weekday, amount, credit, debit FROM f_bank)
SELECT CASE WHEN weekday IS NULL THEN 'hour' WHEN hour IS NULL THEN 'weekday' ELSE 'weekday_hour' END AS level,
  coalesce(weekday, -1) AS weekday, coalesce(hour, -1) AS hour, count(*) AS txns, sum(amount) AS amount,
  coalesce(sum(credit), 0) AS credits, coalesce(sum(debit), 0) AS debits
FROM b GROUP BY GROUPING SETS ((hour), (weekday), (weekday, hour))""")
def a9(t: Tables):
    return ag.activity_levels(t.bank)


view("acc_heat", """
  SELECT c.account_no, c.bank, txns, credit, debit, CAST(least(100, CASE WHEN x.account_no IS NOT NULL THEN 60 ELSE 0 END
     + CASE WHEN upi > 0 AND upi >= txns * 0.8 AND txns >= 10 THEN 10 ELSE 0 END + CASE WHEN credit >= 100000 AND txns >= 10 THEN 10 ELSE 0 END
     + CASE WHEN names >= 15 AND txns >= 25 THEN 15 ELSE 0 END + CASE WHEN phones >= 5 THEN 10 ELSE 0 END + CASE WHEN called THEN 20 ELSE 0 END) AS DOUBLE) AS score,
    concat_ws(',', CASE WHEN x.account_no IS NOT NULL THEN 'COMPLAINED_ACCOUNT' END, CASE WHEN upi > 0 AND upi >= txns * 0.8 AND txns >= 10 THEN 'UPI_HEAVY' END,
      CASE WHEN credit >= 100000 AND txns >= 10 THEN 'HIGH_VOLUME' END, CASE WHEN names >= 15 AND txns >= 25 THEN 'MANY_COUNTERPARTIES' END,
      CASE WHEN phones >= 5 THEN 'MANY_PHONES' END, CASE WHEN called THEN 'PHONE_IN_CALLS' END) AS flags
  FROM (SELECT account_no, min(bank) AS bank, count(*) AS txns, coalesce(sum(credit), 0) AS credit, coalesce(sum(debit), 0) AS debit,
      count(*) FILTER (WHERE mode = 'UPI') AS upi, count(DISTINCT counterparty_name) AS names, count(DISTINCT receiver_phone) AS phones,
      bool_or(receiver_phone IN (SELECT a_number FROM f_cdr)) AS called FROM f_bank GROUP BY 1) c
  LEFT JOIN (SELECT DISTINCT account_no FROM f_complaint) x USING (account_no)""")


@entry("r2_account_heat", "SELECT account_no, txns, credit, debit, score, flags, round(least(0.5 + score / 200, 0.97), 2) AS confidence FROM acc_heat")
def r2(t: Tables):
    return rules.account_heat(t.case).select("account_no", "txns", "credit", "debit", "score", F.array_join("flags", ",").alias("flags"), "confidence")


view("ph_heat", """
  SELECT phone, records, unique_contacts, CAST(CASE WHEN records >= 50 THEN 15 ELSE 0 END + CASE WHEN unique_contacts >= 25 THEN 15 ELSE 0 END
    + CASE WHEN last_ts - first_ts > 5184000 THEN 5 ELSE 0 END AS DOUBLE) AS score FROM phone_prof""")


@entry("r2_phone_heat", "SELECT phone, records, unique_contacts, score FROM ph_heat")
def r2b(t: Tables):
    return rules.phone_heat(t.cdr).select("phone", "records", "unique_contacts", "score")


@entry("a9_day_hour_risk", """
WITH c AS (SELECT (ts // 86400 + 3) % 7 AS weekday, (ts % 86400) // 3600 AS hour, amount,
  CASE WHEN (ts % 86400) // 3600 IN (23, 0, 1, 2, 3, 4) THEN greatest(coalesce(score, 25), 55) ELSE coalesce(score, 25) END AS risk
  FROM f_bank LEFT JOIN acc_heat USING (account_no)),
g AS (SELECT weekday, hour, count(*) AS txns, sum(amount) AS amount, round(avg(risk), 1) AS risk_score FROM c GROUP BY 1, 2)
SELECT *, round(least(100e0, txns * 8 + risk_score * 0.6e0), 1) AS intensity FROM g""")
def a9b(t: Tables):
    return ag.day_hour_risk(t.bank, rules.account_heat(t.case))


def _hist(n: int) -> str:
    return f"""SELECT bucket, count(*) AS txns, sum(amount) AS amount FROM (
  SELECT amount, CAST(least(floor(ln(amount / lo) / ln(hi / lo) * {n}), {n - 1}) AS INTEGER) AS bucket
  FROM f_bank, (SELECT min(amount) AS lo, max(amount) AS hi FROM f_bank WHERE amount > 0) WHERE amount > 0) GROUP BY 1"""


@entry("a10_amount_histogram", _hist(8))
def a10(t: Tables):
    return ag.amount_histogram(t.bank)


@entry("a10_amount_histogram_10", _hist(10))
def a10b(t: Tables):
    return ag.amount_histogram(t.bank, 10)


@entry("a11_session_hours", """
SELECT (start_ts % 86400) // 3600 AS hour, count(*) AS sessions, round(sum((volume_up + volume_down) / 1e6), 2) AS mb FROM f_ipdr GROUP BY 1""")
def a11(t: Tables):
    return ag.session_hours(t.ipdr)


def _shared(src: str, key: str, member: str, least: int, shown: int) -> str:
    return f"""SELECT {key}, member_count, records, members FROM (
  SELECT {key}, count(*) AS member_count, CAST(sum(n) AS BIGINT) AS records,
    string_agg(CASE WHEN r <= {shown} THEN m END, ',' ORDER BY m) AS members FROM (
    SELECT {key}, {member} AS m, count(*) AS n, row_number() OVER (PARTITION BY {key} ORDER BY {member}) AS r FROM {src} GROUP BY 1, 2) GROUP BY 1)
WHERE member_count >= {least} ORDER BY member_count DESC, records DESC, {key} LIMIT 40"""


def members(df):
    return df.withColumn("members", F.array_join("members", ","))


@entry("a12_phone_reuse", _shared("f_bank", "receiver_phone", "account_no", 1, 8))
def a12(t: Tables):
    return members(ag.phone_reuse(t.bank))


@entry("a13_shared_devices", _shared("f_ipdr", "imei", "msisdn", 2, 8))
def a13(t: Tables):
    return members(ag.shared_by(t.ipdr, "imei", "msisdn"))


@entry("a13_shared_ips", _shared("f_ipdr", "source_ip", "msisdn", 2, 10))
def a13b(t: Tables):
    return members(ag.shared_by(t.ipdr, "source_ip", "msisdn", shown=10))


_CODE = "CASE {c} WHEN 'Axis Bank' THEN 'AXIS' WHEN 'HDFC Bank' THEN 'HDFC' WHEN 'ICICI Bank' THEN 'ICICI' WHEN 'State Bank of India' THEN 'SBI' ELSE 'OTHER BANK' END"


@entry("a14_bank_matrix", f"""
SELECT {_CODE.format(c='bank')} AS sender_bank, {_CODE.format(c='counterparty_bank')} AS receiver_bank, count(*) AS txns, sum(amount) AS amount
FROM f_bank GROUP BY 1, 2 ORDER BY amount DESC LIMIT 30""")
def a14(t: Tables):
    return ag.bank_matrix(t.bank)


@entry("a15_circle_activity", """
SELECT circle, coalesce(calls, 0) AS calls, coalesce(long_calls, 0) AS long_calls, coalesce(sessions, 0) AS sessions FROM (
  SELECT roaming_circle AS circle, count(*) AS calls, count(*) FILTER (WHERE duration_sec > 300) AS long_calls FROM f_cdr GROUP BY 1)
FULL JOIN (SELECT roaming_circle AS circle, count(*) AS sessions FROM f_ipdr GROUP BY 1) USING (circle)""")
def a15(t: Tables):
    return ag.circle_activity(t.case)


def _benford(src: str) -> str:
    return f"""WITH c AS (SELECT CAST(left(printf('%.0f', amount), 1) AS INTEGER) AS digit, count(*) AS k FROM {src} WHERE amount >= 10 GROUP BY 1),
d AS (SELECT unnest(range(1, 10)) AS digit, unnest([30.1e0, 17.6e0, 12.5e0, 9.7e0, 7.9e0, 6.7e0, 5.8e0, 5.1e0, 4.6e0]) AS expected_pct),
j AS (SELECT d.digit, expected_pct, coalesce(k, 0) AS observed, (SELECT sum(k) FROM c WHERE digit > 0) AS n FROM d LEFT JOIN c USING (digit)),
x AS (SELECT sum((observed - expected_pct / 100 * n) ** 2 / (expected_pct / 100 * n + 1e-6)) AS chi FROM j)
SELECT CAST(digit AS INTEGER) AS digit, observed, round(observed / n * 100, 2) AS observed_pct, expected_pct, round(chi, 2) AS chi_square,
  CASE WHEN chi > 15.5 THEN 'deviates' ELSE 'conforms' END AS verdict FROM j, x"""


@entry("a16_benford", _benford("f_bank"))
def a16(t: Tables):
    return ag.benford(t.bank)


@entry("a16_benford_ledger", _benford("f_ledger"))
def a16b(t: Tables):
    return ag.benford(t.ledger)


@entry("a18_amount_statistics", """
SELECT count(*) AS n, round(avg(amount), 2) AS mean, round(var_samp(amount), 0) AS variance, min(amount) AS smallest, max(amount) AS largest, """ + ", ".join(
    f"round(quantile_cont(amount, {p / 100}), 2) AS p{p}" for p in (1, 10, 25, 50, 75, 90, 95, 99)) + """,
  round(quantile_cont(amount, 0.25) - 1.5 * (quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25)), 2) AS lower_fence,
  round(quantile_cont(amount, 0.75) + 1.5 * (quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25)), 2) AS upper_fence
FROM f_bank WHERE amount > 0""")
def a18(t: Tables):
    return rounded(ag.amount_statistics(t.bank).withColumn("variance", F.round("variance", 0)))


@entry("a18_top_parties", """
SELECT * FROM (SELECT 'sender' AS role, account_no AS party, count(*) AS txns, coalesce(sum(debit), 0) AS amount FROM f_bank GROUP BY 2 HAVING sum(debit) > 0 ORDER BY 4 DESC, 2 LIMIT 15)
UNION ALL SELECT * FROM (SELECT 'receiver', account_no, count(*), coalesce(sum(credit), 0) FROM f_bank GROUP BY 2 HAVING sum(credit) > 0 ORDER BY 4 DESC, 2 LIMIT 15)
UNION ALL SELECT * FROM (SELECT 'beneficiary', receiver_account, count(*), sum(credit) FROM f_bank WHERE credit > 0 GROUP BY 2 ORDER BY 4 DESC, 2 LIMIT 15)""")
def a18b(t: Tables):
    return ag.top_parties(t.bank)


@entry("a20_dataset_counts", """
SELECT 'bank' AS dataset, count(*) AS records, count(DISTINCT account_no) AS identifiers, min(ts) AS first_ts, max(ts) AS last_ts FROM f_bank
UNION ALL SELECT 'cdr', count(*), count(DISTINCT a_number), min(ts), max(ts) FROM f_cdr
UNION ALL SELECT 'ipdr', count(*), count(DISTINCT msisdn), min(start_ts), max(start_ts) FROM f_ipdr
UNION ALL SELECT 'complaints', count(*), count(DISTINCT account_no), 0, 0 FROM f_complaint
UNION ALL SELECT 'subscribers', count(*), count(DISTINCT msisdn), 0, 0 FROM f_sub""")
def a20(t: Tables):
    return ag.dataset_counts(t.case).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("first_ts", "last_ts")})


@entry("a26_busy_slots", """
WITH s AS (SELECT ts // 1800 AS slot, count(*) AS n FROM f_cdr GROUP BY 1)
SELECT slot * 1800 AS slot_ts, n FROM s, (SELECT avg(n) + 0.5 * stddev_pop(n) AS lim FROM s) WHERE n > lim AND n >= 15""")
def a26(t: Tables):
    return ag.busy_slots(t.cdr, sigma=0.5)


@entry("a26_kind_hours", "SELECT kind, (ts % 86400) // 3600 AS hour, count(*) AS n FROM tl GROUP BY 1, 2")
def a26b(t: Tables):
    return ag.kind_hours(links.timeline(t.case))


@entry("a28_account_totals", """
SELECT account_no, coalesce(sum(debit), 0) AS debit, coalesce(sum(credit), 0) AS credit, count(*) AS txns FROM f_bank GROUP BY 1""")
def a28(t: Tables):
    return ag.account_totals(t.bank)


@entry("a28_ledger_totals", """
SELECT account_no, round(sum(debit), 2) AS debit, count(*) AS txns FROM f_ledger GROUP BY 1""")
def a28b(t: Tables):
    return rounded(ag.account_totals(t.ledger).select("account_no", "debit", "txns"))


# ---------------------------------------------------------------- shared identifiers

view("id_acc", """
  SELECT DISTINCT kind, value, account FROM (
    SELECT 'phone' AS kind, unnest([sender_phone, receiver_phone]) AS value, account_no AS account FROM f_bank
    UNION ALL SELECT 'upi', upi_id, account_no FROM f_bank UNION ALL SELECT 'beneficiary', receiver_account, account_no FROM f_bank
    UNION ALL SELECT 'customer', customer_id, account_no FROM f_bank
    UNION ALL SELECT d.kind, d.value, coalesce(o.account_no, d.phone) FROM (
      SELECT a_number AS phone, unnest(['imei','imsi']) AS kind, unnest([imei, imsi]) AS value FROM f_cdr
      UNION SELECT msisdn, unnest(['imsi','ip']), unnest([imsi, source_ip]) FROM f_ipdr) d
    LEFT JOIN (SELECT DISTINCT unnest([sender_phone, receiver_phone]) AS phone, account_no FROM f_bank) o USING (phone)) WHERE value IS NOT NULL""")
view("ent", """
  SELECT kind, value, account_count, complained, least(100e0, CASE WHEN account_count >= 12 THEN 100e0 ELSE least(100e0, 25e0 * account_count) END
    + CASE WHEN complained THEN 25 ELSE 0 END) AS entity_risk FROM (
    SELECT kind, value, count(*) AS account_count, bool_or(account IN (SELECT account_no FROM f_complaint)) AS complained FROM id_acc GROUP BY 1, 2)
  WHERE account_count >= 2""")
view("expo", """
  SELECT account AS account_no, round(least(100, 0.4 * max(entity_risk) + 0.35 * avg(entity_risk)), 2) AS entity_risk,
    count(*) AS shared_entities, count(DISTINCT kind) AS entity_kinds FROM id_acc JOIN ent USING (kind, value) GROUP BY 1""")


@entry("a21_entity_risk", "SELECT * FROM ent")
def a21(t: Tables):
    return rules.entity_risk(t.case).drop("reasons")


@entry("a21_entity_exposure", "SELECT * FROM expo")
def a21b(t: Tables):
    return rules.entity_exposure(t.case)


@entry("a21_entity_stats", """SELECT kind, count(*) AS entity_count, count(*) FILTER (WHERE entity_risk >= 25) AS flagged_count, max(account_count) AS max_share FROM ent GROUP BY 1""")
def a21c(t: Tables):
    return rules.entity_stats(rules.entity_risk(t.case))


# ---------------------------------------------------------------- behavioural rules

view("im_hist", "SELECT a_number AS phone, imei AS value, imsi || '/' || imei AS pair, ts, 'c' AS src FROM f_cdr UNION ALL SELECT msisdn, imei, imsi || '/' || imei, start_ts, 's' FROM f_ipdr")
view("new_dev", """
  SELECT b.txn_id, min(n.value) AS novel_imei FROM f_bank b JOIN (SELECT DISTINCT phone, value FROM im_hist) n ON n.phone = b.sender_phone
  WHERE ((EXISTS (SELECT 1 FROM im_hist h WHERE h.phone = n.phone AND h.value = n.value AND src = 'c' AND h.ts BETWEEN b.ts AND b.ts + 3600)
      AND NOT EXISTS (SELECT 1 FROM im_hist h WHERE h.phone = n.phone AND h.value = n.value AND src = 'c' AND h.ts < b.ts))
    OR (EXISTS (SELECT 1 FROM im_hist h WHERE h.phone = n.phone AND h.value = n.value AND src = 's' AND h.ts BETWEEN b.ts AND b.ts + 1800)
      AND NOT EXISTS (SELECT 1 FROM im_hist h WHERE h.phone = n.phone AND h.value = n.value AND src = 's' AND h.ts < b.ts)))
    AND (SELECT count(*) FROM im_hist h WHERE h.phone = n.phone AND h.value = n.value AND h.ts < b.ts) <= 2 GROUP BY 1""")
view("rare_dev", """
  SELECT b.txn_id, min(h.value) AS rare_imei FROM f_bank b JOIN im_hist h ON h.phone = b.sender_phone AND src = 'c' AND h.ts BETWEEN b.ts AND b.ts + 3600
  WHERE h.value IN (SELECT value FROM im_hist GROUP BY 1 HAVING count(*) <= 2) GROUP BY 1""")
view("new_pair", """
  SELECT b.txn_id, min(n.pair) AS novel_pair FROM f_bank b JOIN (SELECT DISTINCT phone, pair FROM im_hist) n ON n.phone = b.sender_phone
  WHERE ((EXISTS (SELECT 1 FROM im_hist h WHERE h.phone = n.phone AND h.pair = n.pair AND src = 'c' AND h.ts BETWEEN b.ts AND b.ts + 3600)
      AND NOT EXISTS (SELECT 1 FROM im_hist h WHERE h.phone = n.phone AND h.pair = n.pair AND src = 'c' AND h.ts < b.ts))
    OR (EXISTS (SELECT 1 FROM im_hist h WHERE h.phone = n.phone AND h.pair = n.pair AND src = 'c' AND abs(h.ts - b.ts) <= 172800)
      AND NOT EXISTS (SELECT 1 FROM im_hist h WHERE h.phone = n.phone AND h.pair = n.pair AND src = 's' AND h.ts < b.ts)))
    AND (SELECT count(*) FROM im_hist h WHERE h.phone = n.phone AND h.pair = n.pair AND h.ts < b.ts) <= 2 GROUP BY 1""")
view("moved", """
  SELECT b.txn_id, coalesce((SELECT min(ts) FROM first_cell c WHERE c.phone = b.sender_phone) < b.ts, false)
    AND EXISTS (SELECT 1 FROM first_cell c WHERE c.phone = b.sender_phone AND c.ts >= b.ts AND c.ts < b.ts + 3600) AS moved FROM f_bank b""")
view("rin", """
  SELECT p.*, CAST(left(time, 2) AS INTEGER) AS hour, velocity, median_upper, hour_mode, coalesce(c.calls, 0) AS calls, coalesce(l.n, 0) AS long_calls,
    coalesce(s.sessions, 0) AS sessions, novel_imei, rare_imei, novel_pair, moved
  FROM prior p JOIN veloc USING (txn_id) JOIN base ON customer = customer_id LEFT JOIN pay_calls c USING (txn_id) LEFT JOIN pay_sess s USING (txn_id)
  LEFT JOIN (SELECT s.txn_id, count(*) AS n FROM sides s JOIN long_ends e ON s.phone = e.phone AND e.ts >= s.ts - 3600 AND e.ts < s.ts GROUP BY 1) l USING (txn_id)
  LEFT JOIN new_dev USING (txn_id) LEFT JOIN rare_dev USING (txn_id) LEFT JOIN new_pair USING (txn_id) JOIN moved USING (txn_id)""")


def _w(p: str) -> str:
    return f"CASE WHEN avg(CASE WHEN {p} THEN 1e0 ELSE 0e0 END) <= 0.25 THEN 1e0 ELSE greatest(0.2e0, (1 - avg(CASE WHEN {p} THEN 1e0 ELSE 0e0 END)) / 0.75e0) END"


_ODD = "(hour >= 22 OR hour < 6)"
view("rw", f"""
  SELECT {_w(_ODD)} AS odd, {_w('first_beneficiary AND prior_n >= 1')} AS ben, {_w('long_calls >= 1')} AS calls_w, {_w('sessions >= 1')} AS net,
    {_w('prior_n >= 1 AND abs(hour - hour_mode) >= 6')} AS hdev FROM rin""")


@entry("a30_rule_prevalence", "SELECT round(odd, 6) AS w_odd, round(ben, 6) AS w_ben, round(calls_w, 6) AS w_calls, round(net, 6) AS w_net, round(hdev, 6) AS w_hdev, false AS day_granular FROM rw")
def a30(t: Tables):
    r = rules.rule_inputs(t.case)
    return rounded(rules.rule_prevalence(r, t.bank), 6)


_RULES = [
    (_ODD, "CASE WHEN prior_n >= 3 THEN 30 ELSE 10 END", "odd", "ODD_HOUR_TRANSACTION"),
    ("prior_n >= 1 AND abs(hour - hour_mode) >= 6", "CASE WHEN prior_n >= 3 THEN 20 ELSE 10 END", "hdev", "CUSTOMER_HOUR_DEVIATION"),
    ("median_upper > 0 AND amount > 0 AND ((ratio >= 8 AND prior_n >= 3) OR (ratio >= 5 AND prior_n >= 5) OR (ratio >= 3 AND prior_n >= 10) OR (ratio >= 2 AND prior_n >= 3))",
     "CASE WHEN ratio >= 8 AND prior_n >= 3 THEN 40 WHEN ratio >= 5 AND prior_n >= 5 THEN 30 WHEN ratio >= 3 AND prior_n >= 10 THEN 20 ELSE 15 END", "1", "CUSTOMER_RELATIVE_AMOUNT_SPIKE"),
    ("velocity >= 4", "CASE WHEN velocity >= 6 THEN 50 ELSE 25 END", "1", "AMOUNT_VELOCITY_SPIKE"),
    ("first_beneficiary AND prior_n >= 1", "CASE WHEN prior_n >= 5 THEN 25 ELSE 10 END", "ben", "NEW_BENEFICIARY"),
    ("amount >= 1000 AND CAST(amount AS BIGINT) % 5000 = 0", "10", "1", "ROUND_AMOUNT"),
    ("calls >= 3", "40", "calls_w", "REPEATED_CALLS_BEFORE_TRANSACTION"),
    ("calls BETWEEN 1 AND 2", "30", "calls_w", "UNUSUAL_CALL_BEFORE_TRANSACTION"),
    ("calls >= 1 AND first_beneficiary", "20", "calls_w", "CALL_THEN_NEW_BENEFICIARY"),
    ("calls >= 1 AND median_upper > 0 AND amount >= 3 * median_upper", "25", "calls_w", "CALL_THEN_HIGH_VALUE_TRANSFER"),
    ("sessions >= 3", "30", "net", "NETWORK_SESSION_BURST_AROUND_TRANSACTION"),
    ("novel_imei IS NOT NULL OR rare_imei IS NOT NULL", "CASE WHEN novel_imei IS NOT NULL THEN 30 ELSE 15 END", "net", "NEW_DEVICE_AROUND_TRANSACTION"),
    ("novel_pair IS NOT NULL", "35", "net", "IMSI_IMEI_PAIR_NOVELTY"),
    ("moved", "30", "net", "UNUSUAL_LOCATION_CONTEXT"),
]
_SUM = " + ".join(f"CASE WHEN {c} THEN ({p}) * {w} ELSE 0e0 END" for c, p, w, _ in _RULES)
_LIST = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, _, _, n in _RULES)
view("beh", f"""
  SELECT txn_id AS transaction_id, account_no, customer_id, amount, mode, bank, ts, least(100e0, {_SUM}) AS risk_score, concat_ws(',', {_LIST}) AS rules_fired
  FROM (SELECT *, amount / nullif(median_upper, 0) AS ratio FROM rin), rw""")


@entry("r1_behaviour_scores", """
SELECT transaction_id, account_no, amount, round(risk_score, 4) AS risk_score, rules_fired,
  CASE WHEN risk_score >= 75 THEN 'CRITICAL' WHEN risk_score >= 50 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_band FROM beh""")
def r1(t: Tables):
    return rules.behaviour_scores(t.case).select(
        "transaction_id", "account_no", "amount", F.round("risk_score", 4).alias("risk_score"),
        F.array_join("rules_fired", ",").alias("rules_fired"), "risk_band")
