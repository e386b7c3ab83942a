"""Report tables, evidence cards and case tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, entry, view
from catalog.composites import lifted as lifted_scores
from catalog.composites import scored
from catalog.graphs import layered, seeds
from catalog.queries import legs
from weftline.operators import features as ft
from weftline.operators import graphs as g
from weftline.operators import links
from weftline.plans import composite as cp
from weftline.plans import evidence as ev
from weftline.plans import reports as rp
from weftline.plans import rules
from weftline.session import cut


def loops(t: Tables):
    """Loops that the SQL checks can list: payments of 200 000 and more, four accounts at most."""
    return g.circular_flows(t.bank, 200000, 4, cap=None)


def every_loop(t: Tables):
    """All loops under the operator's own limits (10 000, six accounts)."""
    return g.circular_flows(t.bank, cap=None)


view("loop_rows", """
  WITH e AS (SELECT account_no AS src, receiver_account AS dst, sum(debit) AS amount FROM f_bank WHERE debit >= 200000 AND account_no <> receiver_account GROUP BY 1, 2),
  c AS (SELECT [a.src, a.dst] AS acc, a.amount + b.amount AS flow FROM e a JOIN e b ON b.src = a.dst AND b.dst = a.src WHERE a.dst > a.src
    UNION ALL SELECT [a.src, a.dst, b.dst], a.amount + b.amount + c.amount FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst AND c.dst = a.src WHERE a.dst > a.src AND b.dst > a.src AND b.dst <> a.dst
    UNION ALL SELECT [a.src, a.dst, b.dst, c.dst], a.amount + b.amount + c.amount + d.amount FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst JOIN e d ON d.src = c.dst AND d.dst = a.src
      WHERE a.dst > a.src AND b.dst > a.src AND c.dst > a.src AND b.dst <> a.dst AND c.dst <> a.dst AND c.dst <> b.dst)
  SELECT acc, flow FROM c""")
view("in_out_all", "SELECT * FROM in_out")


@entry("a17_typologies", """
WITH x AS (SELECT (SELECT count(*) FROM f_bank WHERE amount >= 40000 AND amount < 50000) AS s, (SELECT count(*) FROM in_out_all) AS i, (SELECT count(*) FROM loop_rows) AS l,
  (SELECT count(*) FROM payouts) AS p, (SELECT count(*) FROM f_complaint) AS c, (SELECT count(*) FROM f_bank WHERE amount >= 1000000) AS h)
SELECT unnest(['01','02','03','04','05','06']) AS code, unnest(['structuring','in_out','loops','payouts','complaints','high_value']) AS typology, unnest([s, i, l, p, c, h]) AS count,
  unnest([CASE WHEN s >= 3 THEN 'HIGH' ELSE 'LOW' END, CASE WHEN i > 0 THEN 'CRITICAL' ELSE 'SAFE' END, CASE WHEN l > 0 THEN 'CRITICAL' ELSE 'SAFE' END, CASE WHEN p > 0 THEN 'HIGH' ELSE 'SAFE' END,
    CASE WHEN c > 0 THEN 'CRITICAL' ELSE 'SAFE' END, CASE WHEN h > 0 THEN 'MEDIUM' ELSE 'SAFE' END]) AS severity FROM x""")
def a17(t: Tables, loops=loops):
    return rp.typologies(t.case, loops(t), ft.rapid_payouts(t.bank), links.rapid_in_out(t.bank, limit=None))


view("coin_hits", "SELECT t.txn_id, t.receiver_phone AS phone FROM f_bank t WHERE receiver_phone IN (SELECT a_number FROM f_cdr)")
_EXEC = """WITH x AS (SELECT (SELECT max(score) FROM acc_heat) AS top, (SELECT count(*) FROM loop_rows) AS loops, (SELECT count(*) FROM payouts) AS payouts, (SELECT count(*) FROM coin_hits) AS coincidences),
o AS (SELECT *, 30 + CASE WHEN loops > 0 THEN 20 ELSE 0 END + CASE WHEN payouts > 0 THEN 15 ELSE 0 END + CASE WHEN coincidences > 0 THEN 10 ELSE 0 END AS den,
  30 * least(100, top) + CASE WHEN loops > 0 THEN 20 * least(100, 40 + 6 * least(10, loops)) ELSE 0 END + CASE WHEN payouts > 0 THEN 15 * least(100, 30 + 10 * least(7, payouts)) ELSE 0 END
  + CASE WHEN coincidences > 0 THEN 10 * least(100, 20 + 8 * least(10, coincidences)) ELSE 0 END AS num FROM x)
SELECT round(num / den, 1) AS overall_risk, (SELECT count(*) FROM f_bank) AS transactions, (SELECT count(*) FROM acc_heat WHERE flags <> '') AS accounts_flagged,
  (SELECT count(*) FROM acc_heat WHERE score >= 40) + (SELECT count(*) FROM ph_heat WHERE score >= 50) AS suspicious_entities,
  (SELECT count(*) FROM acc_heat WHERE score >= 25 AND score < 50) AS risk_medium, (SELECT count(*) FROM acc_heat WHERE score >= 75) AS risk_critical,
  (SELECT sum(amount) FROM f_bank) AS total_amount, (SELECT sum(credit) FROM f_bank) AS credits, coincidences, loops, payouts FROM o"""


@entry("a19_executive", _EXEC)
def a19(t: Tables, loops=loops):
    e = rp.executive(t.case, rules.account_heat(t.case), rules.phone_heat(t.cdr), loops(t), ft.rapid_payouts(t.bank),
                     links.coincidences(t.case).select("phone"))
    return e.select("overall_risk", "transactions", "accounts_flagged", "suspicious_entities", "risk_medium", "risk_critical", "total_amount", "credits",
                    "coincidences", "loops", "payouts")


@entry("a27_amount_baseline", """
SELECT b.txn_id, b.account_no, amount, n AS history, round(mean, 2) AS mean, round(med, 2) AS median, largest, counterparties, active_days,
  CASE WHEN med > 0 THEN round(amount / med, 1) ELSE 0 END AS deviation_ratio,
  round((SELECT count(*) FROM f_bank x WHERE x.account_no = b.account_no AND x.amount <= b.amount) / n * 100, 1) AS percentile
FROM f_bank b JOIN (SELECT account_no, count(*) AS n, avg(amount) AS mean, median(amount) AS med, max(amount) AS largest, count(DISTINCT coalesce(counterparty_name, receiver_account)) AS counterparties,
  count(DISTINCT date) AS active_days FROM f_bank GROUP BY 1) a USING (account_no) WHERE n >= 2""")
def a27(t: Tables):
    return ev.amount_baseline(t.bank).drop("credits", "debits")


@entry("a27_counterparties", """SELECT account_no, counterparty, n, total, rank FROM (SELECT *, row_number() OVER (PARTITION BY account_no ORDER BY total DESC, counterparty) AS rank FROM (
  SELECT account_no, coalesce(counterparty_name, receiver_account) AS counterparty, count(*) AS n, sum(amount) AS total FROM f_bank GROUP BY 1, 2)) WHERE rank <= 15""")
def a27b(t: Tables):
    return ev.counterparties(t.bank)


@entry("a31_fusion_rollup", """
SELECT (SELECT count(*) FROM fused WHERE call_count > 0) AS call_links, (SELECT count(*) FROM fused WHERE ipdr_count > 0) AS session_links,
  (SELECT count(*) FROM (SELECT DISTINCT account_no, unnest([sender_phone, receiver_phone]) FROM f_bank)) AS phone_account_links, (SELECT count(*) FROM (SELECT DISTINCT source_ip, msisdn FROM f_ipdr)) AS ip_phone_links,
  (SELECT count(*) FROM (SELECT DISTINCT imei, msisdn FROM f_ipdr)) AS device_phone_links, (SELECT count(*) FROM coin_hits) AS temporal_overlaps""")
def a31(t: Tables):
    return rp.fusion_rollup(t.case, links.fused_rows(t.case), links.coincidences(t.case))


@entry("a32_circular_rollup", """
SELECT count(*) AS loop_count, sum(flow) AS total_flow, max(len(acc)) AS longest, round(avg(d.sec), 1) AS avg_cycle_sec, (SELECT count(*) FROM payouts) AS payout_count, (SELECT count(*) FROM in_out_all) AS in_out_count
FROM loop_rows l JOIN LATERAL (SELECT max(ts) - min(ts) AS sec FROM f_bank b WHERE list_contains(l.acc, b.account_no) OR list_contains(l.acc, b.receiver_account)) d ON true""")
def a32(t: Tables, loops=loops):
    return rp.circular_rollup(t.bank, loops(t), ft.rapid_payouts(t.bank), links.rapid_in_out(t.bank, limit=None))


@entry("a32_laundering_indicators", """
SELECT 'Circular layering' AS indicator, CASE WHEN (SELECT max(len(acc)) FROM loop_rows) >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity WHERE EXISTS (SELECT 1 FROM loop_rows)
UNION ALL SELECT 'Rapid cash-out bursts', 'HIGH' WHERE EXISTS (SELECT 1 FROM payouts)
UNION ALL SELECT 'Cash-through (rapid in and out)', 'CRITICAL' WHERE EXISTS (SELECT 1 FROM in_out_all) UNION ALL SELECT 'Structuring watch', 'LOW'""")
def a32b(t: Tables, loops=loops):
    return rp.laundering_indicators(rp.circular_rollup(t.bank, loops(t), ft.rapid_payouts(t.bank), links.rapid_in_out(t.bank, limit=None)))


@entry("a33_recommendations", """
SELECT 'CRITICAL' AS priority, 'Cash-Through' AS category WHERE EXISTS (SELECT 1 FROM in_out_all)
UNION ALL SELECT 'CRITICAL', 'Complaint' WHERE EXISTS (SELECT 1 FROM acc_heat WHERE contains(flags, 'COMPLAINED_ACCOUNT'))
UNION ALL SELECT 'HIGH', 'Money-Flow Loop' WHERE EXISTS (SELECT 1 FROM loop_rows) UNION ALL SELECT 'HIGH', 'Rapid Cash-Out' WHERE EXISTS (SELECT 1 FROM payouts)
UNION ALL SELECT 'HIGH', 'Rule Engine' WHERE EXISTS (SELECT 1 FROM acc_heat WHERE score >= 75)
UNION ALL SELECT 'MEDIUM', 'Telecom Correlation' WHERE EXISTS (SELECT 1 FROM fused WHERE call_count > 0 OR ipdr_count > 0)""")
def a33(t: Tables, loops=loops):
    roll = rp.circular_rollup(t.bank, loops(t), ft.rapid_payouts(t.bank), links.rapid_in_out(t.bank, limit=None))
    return rp.recommendations(roll, rules.account_heat(t.case), rp.fusion_rollup(t.case, links.fused_rows(t.case), links.coincidences(t.case).select("phone"))).drop("action")


#: The same reports over every loop; DuckDB cannot list those on the larger tables, so tests hold them against brute force.
for _name, _report in (("a17_typologies", a17), ("a19_executive", a19), ("a32_circular_rollup", a32), ("a32_laundering_indicators", a32b), ("a33_recommendations", a33)):
    entry(f"{_name}_every_loop")(lambda t, report=_report: report(t, every_loop))


_VOL = "count(*) AS transactions, coalesce(sum(credit), 0) AS credit, coalesce(sum(debit), 0) AS debit, round(avg(amount), 2) AS avg_amount, max(amount) AS max_amount, count(*) FILTER (WHERE debit >= 1000 AND CAST(debit AS BIGINT) % 5000 = 0) AS round_amounts"
_NOVOL = "0 AS transactions, 0 AS credit, 0 AS debit, 0 AS avg_amount, 0 AS max_amount, 0 AS round_amounts"


def _ids(kind: str, col: str) -> str:
    return (f"SELECT '{kind}' AS kind, {col} AS value, count(*) FILTER (WHERE s = 'c') AS calls, count(*) FILTER (WHERE s = 'i') AS ip_sessions, {_NOVOL} FROM "
            f"(SELECT {col}, 'c' AS s FROM f_cdr UNION ALL SELECT {col}, 'i' FROM f_ipdr) GROUP BY 2")


@entry("c1_entity_cards", f"""
SELECT 'account' AS kind, account_no AS value, 0 AS calls, 0 AS ip_sessions, {_VOL} FROM f_bank GROUP BY 2
UNION ALL SELECT 'upi', upi_id, 0, 0, {_VOL} FROM f_bank WHERE upi_id IS NOT NULL GROUP BY 2
UNION ALL SELECT 'name', lower(counterparty_name), 0, 0, {_VOL} FROM f_bank WHERE counterparty_name IS NOT NULL GROUP BY 2
UNION ALL {_ids('imei', 'imei')} UNION ALL {_ids('imsi', 'imsi')}
UNION ALL SELECT 'ip', source_ip, 0, count(*), {_NOVOL} FROM f_ipdr GROUP BY 2
UNION ALL SELECT 'phone', value, coalesce(c.n, 0), coalesce(i.n, 0), coalesce(transactions, 0), coalesce(credit, 0), coalesce(debit, 0), coalesce(avg_amount, 0), coalesce(max_amount, 0), coalesce(round_amounts, 0)
  FROM (SELECT phone AS value, {_VOL} FROM (SELECT DISTINCT txn_id, unnest([sender_phone, receiver_phone]) AS phone, credit, debit, amount FROM f_bank) GROUP BY 1) p
  FULL JOIN (SELECT a_number AS value, count(*) AS n FROM f_cdr GROUP BY 1) c USING (value) FULL JOIN (SELECT msisdn AS value, count(*) AS n FROM f_ipdr GROUP BY 1) i USING (value)""")
def c1(t: Tables):
    return ev.entity_cards(t.case)


@entry("k7_latest_records", """SELECT entity, kind, record_id, n FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, kind, record_id) AS n FROM tl) WHERE n <= 15""")
def k7(t: Tables):
    return ev.latest_records(links.timeline(t.case)).select("entity", "kind", "record_id", "n")


@entry("c2_call_pairs", """SELECT least(a_number, b_number) AS a, greatest(a_number, b_number) AS b, count(*) AS calls, CAST(sum(duration_sec) AS BIGINT) AS total_seconds, round(avg(duration_sec), 1) AS avg_seconds,
  max(duration_sec) AS max_seconds FROM f_cdr WHERE a_number <> b_number GROUP BY 1, 2""")
def c2(t: Tables):
    return ev.call_pairs(t.cdr).select("a", "b", "calls", "total_seconds", "avg_seconds", "max_seconds")


@entry("c2_money_pairs", """SELECT least(account_no, receiver_account) AS a, greatest(account_no, receiver_account) AS b, count(*) FILTER (WHERE account_no < receiver_account) AS forward_count,
  coalesce(sum(debit) FILTER (WHERE account_no < receiver_account), 0) AS forward_total, count(*) FILTER (WHERE account_no > receiver_account) AS back_count,
  coalesce(sum(debit) FILTER (WHERE account_no > receiver_account), 0) AS back_total FROM f_bank WHERE account_no <> receiver_account GROUP BY 1, 2""")
def c2b(t: Tables):
    return ev.money_pairs(t.bank).select("a", "b", "forward_count", "forward_total", "back_count", "back_total")


@entry("c2_account_phone_pairs", """
WITH r AS (SELECT DISTINCT txn_id, account_no, unnest([sender_phone, receiver_phone]) AS phone, amount FROM f_bank),
w AS (SELECT t.txn_id, t.account_no, t.receiver_phone AS phone, count(*) AS n FROM f_bank t JOIN f_cdr c ON t.receiver_phone = c.a_number AND c.ts BETWEEN t.ts - 3600 AND t.ts + 3600 GROUP BY ALL)
SELECT account_no, phone, payments, total, coalesce(coincidences, 0) AS coincidences, coalesce(calls_in_window, 0) AS calls_in_window FROM (SELECT account_no, phone, count(*) AS payments, sum(amount) AS total FROM r GROUP BY 1, 2)
LEFT JOIN (SELECT account_no, phone, count(*) AS coincidences, CAST(sum(n) AS BIGINT) AS calls_in_window FROM w GROUP BY 1, 2) USING (account_no, phone)""")
def c2c(t: Tables):
    return ev.account_phone_pairs(t.bank, links.coincidences(t.case)).drop("largest")


@entry("c3_event_dossiers", """SELECT e.kind, e.record_id, count(a.near_id) AS nearby, coalesce(min(a.gap), -1) AS nearest_gap FROM tl e LEFT JOIN around a USING (ts) GROUP BY 1, 2""")
def c3(t: Tables):
    d = ev.event_dossiers(t.case, links.events_around(links.timeline(t.case)))
    return d.select("kind", "record_id", "nearby", F.coalesce("nearest_gap", F.lit(-1)).alias("nearest_gap"))


@entry("c4_account_dossiers", """SELECT account_no, count(*) AS transactions, coalesce(sum(credit), 0) + coalesce(sum(debit), 0) AS turnover, count(DISTINCT receiver_account) AS receivers, count(DISTINCT receiver_phone) AS phones,
  count(DISTINCT upi_id) AS upi_ids FROM f_bank GROUP BY 1""")
def c4(t: Tables):
    return ev.account_dossiers(t.case).select("account_no", "transactions", "turnover", "receivers", "phones", "upi_ids")


view("fflow", """
  SELECT b.txn_id, b.account_no, b.amount, coalesce(i.n, 0) AS inflows, coalesce(i.s, 0) AS total_inflow, coalesce(o.n, 0) AS outflows, coalesce(o.s, 0) AS total_outflow,
    CASE WHEN i.s > 0 THEN round((i.s - coalesce(o.s, 0)) / i.s * 100, 1) + 0e0 ELSE 0e0 END AS retention_pct FROM f_bank b
  LEFT JOIN (SELECT account_no, count(*) AS n, sum(credit) AS s FROM f_bank WHERE credit > 0 GROUP BY 1) i USING (account_no)
  LEFT JOIN (SELECT account_no AS r, count(*) AS n, sum(debit) AS s FROM f_bank WHERE debit > 0 GROUP BY 1) o ON o.r = b.receiver_account""")


@entry("c5_funds_flow", "SELECT * FROM fflow")
def c5(t: Tables):
    return ev.funds_flow(t.bank).drop("receiver_account")


def alerts(t: Tables):
    """Large payments as alerts, as the SQL of c6 has them."""
    return t.bank.where("debit >= 300000").select(F.col("txn_id").alias("transaction_id"), F.least(F.lit(100.0), F.col("debit") / 5000).alias("risk_score"))


def every_alert(t: Tables):
    """The whole alert feed; several jobs read it, so it is written once."""
    s = scored(t)
    return cut(cp.alert_feed(s, t.case, limit=None).select("transaction_id", "risk_score"))


view("dayk", """SELECT b.txn_id, count(*) AS k FROM (SELECT DISTINCT txn_id, (ts + 19800) // 86400 AS d, unnest([sender_phone, receiver_phone]) AS phone FROM f_bank) b
  JOIN call_ends c ON c.phone = b.phone AND (c.ts + 19800) // 86400 = b.d GROUP BY 1""")
view("sdev", "SELECT a_number AS phone, count(DISTINCT imei) AS d FROM f_cdr WHERE imei IN (SELECT imei FROM f_cdr GROUP BY 1 HAVING count(DISTINCT a_number) >= 2) GROUP BY 1")
_MED = "(SELECT account_no, median(amount) AS med, count(*) AS n FROM f_bank GROUP BY 1)"


@entry("c6_red_flags", f"""
SELECT txn_id, upper(left(sha256(txn_id), 8)) AS case_code, concat_ws(',', CASE WHEN ratio >= 10 THEN 'Unusual Transaction Size' END, CASE WHEN complained THEN 'Fraud Complaint' END) AS critical,
  concat_ws(',', CASE WHEN outflows >= 2 THEN 'Layering' END, CASE WHEN amount >= 5000 AND CAST(amount AS BIGINT) % 5000 = 0 AND amount < 50000 THEN 'Structuring' END,
    CASE WHEN retention_pct < 15 AND outflows > 0 THEN 'Pass-Through Account' END, CASE WHEN ratio >= 10 THEN 'Burst Activity' END, CASE WHEN sd > 0 THEN 'Shared-Device Ring' END) AS typologies
FROM (SELECT f.*, CASE WHEN n >= 2 AND med > 0 THEN round(f.amount / med, 1) ELSE 0 END AS ratio, f.account_no IN (SELECT account_no FROM f_complaint) AS complained,
    coalesce((SELECT sum(d) FROM sdev WHERE phone IN (b.sender_phone, b.receiver_phone)), 0) AS sd FROM fflow f JOIN f_bank b USING (txn_id) JOIN {_MED} m ON m.account_no = f.account_no WHERE b.debit >= 300000)""")
def c6(t: Tables, alerts=alerts):
    found = alerts(t)
    f = ev.red_flags(ev.case_evidence(t.case, found))
    crit = F.array_sort(F.transform(F.filter("flags", lambda x: x["severity"] == "CRITICAL"), lambda x: F.when(x["indicator"] == "Fraud Complaint", F.lit("2")).otherwise(F.lit("1"))))
    names = F.transform(crit, lambda c: F.when(c == "1", "Unusual Transaction Size").otherwise("Fraud Complaint"))
    return f.select("txn_id", "case_code", F.array_join(names, ",").alias("critical"), F.array_join("typologies", ",").alias("typologies"))


@entry("c6_red_flags_alert_feed")
def c6b(t: Tables):
    return c6(t, every_alert)


@entry("c7_narratives")
def c7(t: Tables):
    found = every_alert(t)
    e = ev.case_evidence(t.case, found)
    return ev.narratives(e, ev.red_flags(e))


@entry("c9_graph_insights", """SELECT seed, count(*) AS edges, sum(amount) AS total FROM traced GROUP BY 1""")
def c9(t: Tables):
    edges = cut(layered(t))
    # the last of three layers touches no further edge, so it is not searched
    return g.reached_totals(g.reach(seeds(t), edges, 2), edges, 2)


@entry("c10_result_intelligence", """
SELECT mode, arg_min(account_no, (-a, account_no)) AS primary_account FROM (SELECT mode, account_no, count(*) AS a FROM f_bank GROUP BY 1, 2) GROUP BY 1""")
def c10(t: Tables):
    return ev.result_intelligence(t.bank, "mode").select("mode", "primary_account")


@entry("c12_activity_bundle", """
SELECT phone, coalesce(p.n, 0) AS payments, coalesce(c.n, 0) AS calls, coalesce(s.n, 0) AS sessions, coalesce(p.debit, 0) AS debit FROM (
  SELECT phone, count(*) AS n, coalesce(sum(debit), 0) AS debit FROM (SELECT DISTINCT txn_id, unnest([sender_phone, receiver_phone]) AS phone, debit FROM f_bank) GROUP BY 1) p
FULL JOIN (SELECT phone, count(*) AS n FROM call_ends GROUP BY 1) c USING (phone) FULL JOIN (SELECT msisdn AS phone, count(*) AS n FROM f_ipdr GROUP BY 1) s USING (phone)""")
def c12(t: Tables):
    return ev.activity_bundle(t.case).select("phone", "payments", "calls", "sessions", "debit")


@entry("c13_result_summary", """SELECT mode, count(*) AS records, sum(amount) AS total, min(date) AS first_date, max(date) AS last_date, count(DISTINCT account_no) AS accounts, count(DISTINCT receiver_account) AS beneficiaries,
  round(avg(CASE WHEN left(time, 2) >= '22' OR left(time, 2) < '06' THEN 1 ELSE 0 END), 4) AS night_share FROM f_bank GROUP BY 1""")
def c13(t: Tables):
    return ev.result_summary(t.bank, "mode").drop("modes")


@entry("r13_top_leads", """SELECT mode, n, transaction_id FROM (SELECT mode, transaction_id, row_number() OVER (PARTITION BY mode ORDER BY risk_score DESC, transaction_id) AS n FROM beh) WHERE n <= 5""")
def r13(t: Tables):
    return ev.top_leads(rules.behaviour_scores(t.case), "mode").select("mode", "n", "transaction_id")


@entry("j18_related_payments", """
WITH p AS (SELECT a.txn_id, b.txn_id AS other_id, b.ts FROM f_bank a JOIN f_bank b ON a.account_no = b.account_no AND a.txn_id <> b.txn_id
  UNION SELECT a.txn_id, b.txn_id, b.ts FROM f_bank a JOIN f_bank b ON (a.receiver_account = b.receiver_account OR a.receiver_account = b.account_no) AND a.txn_id <> b.txn_id
  UNION SELECT a.txn_id, b.txn_id, b.ts FROM f_bank a JOIN (SELECT * FROM f_bank QUALIFY row_number() OVER (PARTITION BY date ORDER BY ts, txn_id) <= 41) b ON a.date = b.date AND a.txn_id <> b.txn_id
  UNION SELECT a.txn_id, b.txn_id, b.ts FROM f_bank a JOIN f_bank b ON a.counterparty_name = b.counterparty_name AND a.txn_id <> b.txn_id)
SELECT txn_id, other_id, n FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY ts, other_id) AS n FROM p) WHERE n <= 40""")
def j18(t: Tables):
    return links.related_payments(t.bank).select("txn_id", "other_id", "n")
