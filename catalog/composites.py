"""Composite scores, scenarios, alerts, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, entry, view
from weftline.functions.phrases import PHRASES
from weftline.operators import features as ft
from weftline.operators import graphs as g
from weftline.operators.context import payment_context
from weftline.plans import composite as cp
from weftline.plans import rules
from weftline.plans import scenarios as sc
from weftline.session import cut


def band_sql(c: str) -> str:
    return f"CASE WHEN {c} >= 85 THEN 'CRITICAL' WHEN {c} >= 70 THEN 'HIGH' WHEN {c} >= 50 THEN 'MEDIUM' WHEN {c} >= 25 THEN 'LOW' ELSE 'SAFE' END"


def joined(col):
    return F.coalesce(F.array_join(col, ","), F.lit(""))


view("parts", """
  SELECT b.transaction_id, b.account_no, b.amount, b.mode, b.bank, b.ts, b.rules_fired, round(b.risk_score, 6) AS rules, t.txn_ml_score AS ml,
    d.profile_score AS behaviour, d.dormant, s.temporal_score AS temporal, s.calls_in_window, s.sessions_in_window, c.call_assist_score AS telecom,
    c.calls_before, i.internet_score AS internet, i.shared_ips
  FROM beh b JOIN tml t ON t.txn_id = transaction_id JOIN dev d ON d.txn_id = transaction_id JOIN tscore s ON s.txn_id = transaction_id
  JOIN cassist c ON c.txn_id = transaction_id JOIN inet i ON i.txn_id = transaction_id""")
view("hyb", f"""
  SELECT *, {band_sql('risk_score')} AS risk_band FROM (
  SELECT *, round(least(100, 0.30e0 * rules + 0.20e0 * ml + 0.25e0 * behaviour + 0.10e0 * temporal + 0.10e0 * telecom + 0.05e0 * internet), 2) AS risk_score,
    concat_ws(',', CASE WHEN rules >= 25 THEN 'rules' END, CASE WHEN ml >= 25 THEN 'ml' END, CASE WHEN behaviour >= 25 THEN 'behaviour' END,
      CASE WHEN temporal >= 25 THEN 'temporal' END, CASE WHEN telecom >= 25 THEN 'telecom' END, CASE WHEN internet >= 25 THEN 'internet' END) AS models_fired FROM parts)""")


def scored(t: Tables):
    """Component scores are read by several consumers: written once. So are the records, which the scores scan some eighty times."""
    t.keep()
    return cp.transaction_composite(cut(cp.transaction_parts(t.case)), cp.WEIGHTS)


@entry("r5_transaction_composite", "SELECT transaction_id, account_no, round(rules, 4) AS rules, ml, behaviour, temporal, telecom, internet, round(risk_score, 1) AS risk_score, models_fired FROM hyb")
def r5(t: Tables):
    s = scored(t)
    return s.select("transaction_id", "account_no", F.round("rules", 4).alias("rules"), "ml", "behaviour", "temporal", "telecom", "internet",
                    F.round("risk_score", 1).alias("risk_score"), joined("models_fired").alias("models_fired"))


@entry("p9_transactions_by_score", "SELECT transaction_id, risk_band FROM hyb WHERE risk_score >= 30")
def p9(t: Tables):
    return scored(t).where("risk_score >= 30").select("transaction_id", "risk_band")


view("acomp", f"""
  SELECT *, {band_sql('risk_score')} AS risk_band FROM (
  SELECT h.account_no, h.score AS rules, h.flags, d.behaviour_score AS behaviour, t.temporal_score AS temporal, e.entity_risk AS entity, e.shared_entities,
    m.flow_score AS moneyflow, m.layering_depth, m.circular,
    round(least(100, (0.30e0 * h.score + 0.10e0 * d.behaviour_score + 0.05e0 * t.temporal_score + 0.10e0 * e.entity_risk + 0.05e0 * m.flow_score) / 0.6e0), 2) AS risk_score
  FROM acc_heat h JOIN accdev d USING (account_no) JOIN acctemp t USING (account_no) JOIN expo e USING (account_no) JOIN mflow m USING (account_no))""")


@entry("r5_account_composite", """
SELECT h.account_no, rules, behaviour, temporal, entity, moneyflow, round(risk_score, 0) AS risk_score, flags FROM acomp h
WHERE account_no IN (SELECT account_no FROM f_bank)""")
def r5b(t: Tables):
    a = cp.account_composite(t.case, w=cp.WEIGHTS).join(t.bank.select("account_no").distinct(), "account_no", "left_semi")
    return a.select("account_no", "rules", "behaviour", "temporal", "entity", "moneyflow", F.round("risk_score", 0).alias("risk_score"),
                    joined("flags").alias("flags"))


view("call_deg", """SELECT node, count(*) AS degree FROM (SELECT DISTINCT unnest(['o','i']) AS d, a_number, b_number, unnest([a_number, b_number]) AS node
  FROM f_cdr WHERE duration_sec >= 10) GROUP BY 1""")


@entry("r10_entity_composite", """
SELECT kind, value, account_count, entity_risk, round(tel, 2) AS telecom, net AS internet,
  round((0.35e0 * entity_risk + 0.15e0 * tel + 0.10e0 * net), 1) AS risk_score FROM (
  SELECT e.*, CASE WHEN kind = 'phone' THEN least(100e0, coalesce(d.degree, 0) * 3) ELSE 0 END AS tel, CASE WHEN kind = 'ip' THEN coalesce(s.shared_ip_score, 0) ELSE 0 END AS net
  FROM ent e LEFT JOIN call_deg d ON d.node = e.value LEFT JOIN sip s ON s.ip = e.value)""")
def r10(t: Tables):
    return cp.entity_composite(t.case, cp.WEIGHTS).select("kind", "value", "account_count", "entity_risk", "telecom", "internet",
                                                          F.round("risk_score", 1).alias("risk_score"))


view("rmg", f"SELECT account_no, score AS rules, round(score, 2) AS risk_score, {band_sql('score')} AS risk_band FROM acc_heat")


@entry("r6_account_risk", "SELECT * FROM rmg")
def r6(t: Tables):
    return cp.rule_ml_graph(rules.account_heat(t.case), None, None).select("account_no", "rules", "risk_score", "risk_band")


view("lifted", f"""
  SELECT *, {band_sql('risk_score')} AS risk_band FROM (SELECT b.transaction_id, b.account_no, b.amount, b.rules_fired, b.risk_score AS behavioural, r.risk_score AS account_risk,
    t.txn_ml_score, round(least(100, greatest(b.risk_score, 0.6e0 * r.risk_score, 0.7e0 * t.txn_ml_score)), 2) AS risk_score
  FROM beh b JOIN rmg r USING (account_no) JOIN tml t ON t.txn_id = b.transaction_id)""")


def lifted(t: Tables):
    context = cut(payment_context(t.case))
    return cp.lifted_transactions(rules.behaviour_scores(t.case, context), cp.rule_ml_graph(rules.account_heat(t.case), None, None),
                                  ft.transaction_ml(ft.transaction_matrix(t.case, context)))


@entry("r6_transaction_risk", "SELECT transaction_id, round(behavioural, 4) AS behavioural, account_risk, txn_ml_score, round(risk_score, 1) AS risk_score FROM lifted")
def r6b(t: Tables):
    return lifted(t).select("transaction_id", F.round("behavioural", 4).alias("behavioural"), "account_risk", "txn_ml_score",
                            F.round("risk_score", 1).alias("risk_score"))


@entry("k3_top_transactions", "SELECT transaction_id, risk_band FROM lifted ORDER BY risk_score DESC, txn_ml_score DESC, account_risk DESC, transaction_id LIMIT 50")
def k3(t: Tables):
    return cp.top_transactions(lifted(t), 50).select("transaction_id", "risk_band")


view("conf", "SELECT transaction_id, round(least(0.5 + risk_score / 200, 0.97), 2) AS confidence FROM beh")
_MAP = "MAP {" + ", ".join("'{}': '{}'".format(k, v.replace("'", "''")) for k, v in PHRASES.items()) + "}"
view("alerts", f"""
  SELECT h.transaction_id, h.account_no, h.amount, least(100, h.risk_score + CASE WHEN c THEN 60 ELSE 0 END) AS risk_score,
    CASE WHEN NOT c THEN h.risk_band WHEN h.risk_score + 60 >= 75 THEN 'CRITICAL' WHEN h.risk_score + 60 >= 50 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_band,
    concat_ws(',', nullif(rules_fired, ''), CASE WHEN c THEN 'COMPLAINED_ACCOUNT' END) AS rules_fired, confidence
  FROM (SELECT *, account_no IN (SELECT account_no FROM f_complaint) AS c FROM hyb) h JOIN conf USING (transaction_id)""")
view("alerts_top", "SELECT * FROM alerts WHERE risk_score >= 50 ORDER BY risk_score DESC, transaction_id LIMIT 100")


@entry("r11_alert_feed", """
SELECT a.transaction_id, a.account_no, round(a.risk_score, 1) AS risk_score, a.risk_band, a.rules_fired, b.account_name AS sender_name,
  coalesce(b.counterparty_name, b.merchant_name, '') AS receiver_name, b.receiver_account, b.date, b.time, b.mode
FROM alerts_top a JOIN f_bank b ON b.txn_id = a.transaction_id""")
def r11(t: Tables):
    a = cp.alert_feed(scored(t), t.case)
    return a.select("transaction_id", "account_no", F.round("risk_score", 1).alias("risk_score"), "risk_band", joined("rules_fired").alias("rules_fired"),
                    "sender_name", F.coalesce("receiver_name", F.lit("")).alias("receiver_name"), "receiver_account", "date", "time", "mode")


@entry("x18_plain_reasons", f"""
WITH r AS (SELECT b.transaction_id, b.amount, confidence, list_transform(CASE WHEN rules_fired = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(rules_fired, ',') END,
    lambda x: {_MAP}[x]) AS said FROM beh b JOIN conf USING (transaction_id))
SELECT transaction_id, 'Transaction ' || transaction_id || CASE WHEN amount <> 0 THEN ' of Rs ' || printf('%.0f', amount) ELSE '' END || ' is flagged suspicious because: '
  || CASE len(said) WHEN 0 THEN 'the combined score lies far outside similar records' WHEN 1 THEN said[1]
     ELSE array_to_string(list_transform(said, lambda p, i: '(' || i || ') ' || p), '; ') END
  || '.' || ' Model confidence is ' || CAST(round(confidence * 100, 0) AS INTEGER) || '%.' AS reason FROM r""")
def x18(t: Tables):
    from weftline.functions.phrases import plain_reason
    b = rules.behaviour_scores(t.case)
    return b.select("transaction_id", plain_reason(F.col("rules_fired"), F.col("amount"), F.col("transaction_id"), F.col("confidence")).alias("reason"))


@entry("p12_enriched_rows", """
SELECT b.txn_id AS transaction_id, b.account_no, b.account_name AS sender_name, coalesce(b.counterparty_name, b.merchant_name, '') AS receiver_name,
  b.sender_phone, b.receiver_phone, b.date, b.mode FROM f_bank b""")
def p12(t: Tables):
    rows = t.bank.select(F.col("txn_id").alias("transaction_id"), "account_no")
    return cp.enrich(rows, t.bank).select("transaction_id", "account_no", "sender_name", F.coalesce("receiver_name", F.lit("")).alias("receiver_name"),
                                          "sender_phone", "receiver_phone", "date", "mode")


# ---------------------------------------------------------------- scenarios

def _sev(x: str) -> str:
    return f"CASE WHEN {x} >= 75 THEN 'CRITICAL' WHEN {x} >= 50 THEN 'HIGH' WHEN {x} >= 30 THEN 'MEDIUM' ELSE 'LOW' END"


def _sc(cond: str, name: str, sev: str, base: float, signals: list[str]) -> str:
    hits = " + ".join(f"CASE WHEN {s} THEN 1 ELSE 0 END" for s in signals)
    sev = sev if sev.startswith("CASE") else f"'{sev}'"
    return f"SELECT *, '{name}' AS scenario, {sev} AS severity, round(least(0.97e0, {base}e0 + 0.12e0 * ({hits})), 2) AS confidence FROM flagged WHERE {cond}"


def _on(r: str) -> str:
    return f"list_contains(string_split(rules_fired, ','), '{r}')"


view("flagged", f"""
  SELECT p.*, coalesce(layering_depth, 0) AS depth, coalesce(mule_chain, false) AS mule, coalesce(rapid_forward, false) AS fwd, coalesce(cash_out_payouts, 0) AS cash,
    coalesce(shared_entities, 0) AS shared, {_on('ODD_HOUR_TRANSACTION')} AS night, {_on('CUSTOMER_RELATIVE_AMOUNT_SPIKE')} AS spike, {_on('AMOUNT_VELOCITY_SPIKE')} AS burst,
    {_on('NEW_BENEFICIARY')} AS new_ben, {_on('ROUND_AMOUNT')} AS rnd, {_on('UNUSUAL_CALL_BEFORE_TRANSACTION')} OR {_on('REPEATED_CALLS_BEFORE_TRANSACTION')} AS call,
    {_on('NEW_DEVICE_AROUND_TRANSACTION')} AS dev, {_on('IMSI_IMEI_PAIR_NOVELTY')} AS pair, {_on('UNUSUAL_LOCATION_CONTEXT')} AS loc, {_on('NETWORK_SESSION_BURST_AROUND_TRANSACTION')} AS net
  FROM parts p LEFT JOIN mflow USING (account_no) LEFT JOIN expo USING (account_no)""")
_NAMED = [
    _sc("burst OR temporal >= 40", "Rapid In-Out", _sev("40 + temporal"), 0.55, ["burst", "temporal >= 40", "call"]),
    _sc("burst AND amount >= 100000", "Burst Transactions", "CRITICAL", 0.6, ["true", "night"]),
    _sc("rnd", "Structuring", _sev("30 + CASE WHEN night THEN 25 ELSE 0 END"), 0.5, ["rnd", "night"]),
    _sc("rnd AND new_ben", "Smurfing", "HIGH", 0.6, ["rnd", "new_ben"]),
    _sc("depth >= 2 OR mule", "Layering", _sev("45 + 15 * depth"), 0.5, ["depth >= 2", "mule"]),
    _sc("fwd OR (cash >= 4 AND amount >= 25000)", "Money Mule", "HIGH", 0.55, ["fwd", "cash >= 4"]),
    _sc("shared >= 3", "Shared Device Fraud", _sev("40 + 10 * shared"), 0.5, ["dev", "shared >= 5"]),
    _sc("dev", "Device Change", _sev("40 + CASE WHEN spike THEN 15 ELSE 0 END"), 0.5, ["dev", "pair"]),
    _sc("pair", "SIM Swap", _sev("45 + CASE WHEN dev THEN 10 ELSE 0 END"), 0.55, ["pair", "dev"]),
    _sc("loc", "Location Jump", _sev("40 + CASE WHEN spike THEN 15 ELSE 0 END"), 0.5, ["loc", "net"]),
    _sc("call OR telecom >= 40", "Call Assisted Fraud", _sev("40 + telecom * 0.3"), 0.55, ["call", "telecom >= 40", "new_ben", "spike"]),
    _sc("call AND new_ben", "Telecom Coordinated Fraud", "HIGH", 0.6, ["call", "new_ben", "spike"]),
    _sc("net AND shared_ips > 0", "Internet Coordinated Fraud", "HIGH", 0.55, ["net", "internet >= 25"]),
    _sc("dormant", "Dormant Account Activation", _sev("40 + behaviour * 0.3"), 0.5, ["behaviour >= 30", "spike", "new_ben"]),
    _sc("behaviour >= 50 AND (spike OR night OR new_ben)", "Account Takeover", _sev("45 + behaviour * 0.3"), 0.55, ["spike", "new_ben", "night", "behaviour >= 70"]),
]
view("tnamed", " UNION ALL ".join(_NAMED))
view("tscen", f"""
  SELECT transaction_id, account_no, scenario, severity, confidence FROM tnamed UNION ALL
  SELECT transaction_id, account_no, scenario, severity, confidence FROM ({_sc("(spike OR burst OR behaviour >= 40 OR temporal >= 40)", "Unknown Behaviour",
    _sev("greatest(30, behaviour, temporal)"), 0.45, ["spike", "burst", "behaviour >= 40"])} AND transaction_id NOT IN (SELECT transaction_id FROM tnamed))""")


def scenario_rows(df, key):
    return df.select(key, F.explode("scenarios").alias("s")).select(key, "s.scenario", "s.severity", "s.confidence")


def txn_scenarios(t: Tables, parts=None, flow=None):
    parts = parts if parts is not None else cp.transaction_parts(t.case)
    return sc.transaction_scenarios(parts, flow if flow is not None else g.money_flow(t.bank), rules.entity_exposure(t.case))


@entry("r8_transaction_scenarios", "SELECT transaction_id, scenario, severity, confidence FROM tscen")
def r8(t: Tables):
    return scenario_rows(txn_scenarios(t), "transaction_id")


def _asc(cond: str, name: str, sev: str, base: float, signals: list[str]) -> str:
    return _sc(cond, name, sev, base, signals).replace("FROM flagged", "FROM aflag")


view("aflag", "SELECT m.*, coalesce(shared_entities, 0) AS shared, dormant_activated, deviating_share FROM mflow m LEFT JOIN expo USING (account_no) LEFT JOIN accdev USING (account_no)")
view("ascen", "SELECT account_no, scenario, severity, confidence FROM (" + " UNION ALL ".join([
    _asc("circular", "Circular Flow", "HIGH", 0.6, ["true", "layering_depth >= 2"]),
    _asc("layering_depth >= 3", "Layering", "HIGH", 0.55, ["layering_depth >= 3", "mule_chain"]),
    _asc("cash_out_payouts >= 8", "Money Mule", "HIGH", 0.55, ["cash_out_payouts >= 8", "rapid_forward"]),
    _asc("shared >= 4", "Shared Beneficiary", _sev("35 + 8 * shared"), 0.5, ["shared >= 6"]),
    _asc("dormant_activated", "Dormant Account Activation", "HIGH", 0.55, ["true", "deviating_share >= 0.3"])]) + ")")


def acc_scenarios(t: Tables, flow=None):
    return sc.account_scenarios(flow if flow is not None else g.money_flow(t.bank), rules.entity_exposure(t.case),
                                ft.account_deviation(ft.profile_deviation(t.bank)))


@entry("r9_account_scenarios", "SELECT account_no, scenario, severity, confidence FROM ascen")
def r9(t: Tables):
    return scenario_rows(acc_scenarios(t), "account_no")


@entry("r9_scenario_counts", """SELECT scenario, count(*) AS count FROM (SELECT scenario FROM tscen UNION ALL SELECT scenario FROM ascen) GROUP BY 1 ORDER BY count DESC, scenario LIMIT 10""")
def r9b(t: Tables):
    flow = cut(g.money_flow(t.bank))
    return sc.scenario_counts(txn_scenarios(t, flow=flow), acc_scenarios(t, flow=flow))


view("top_scen", "SELECT transaction_id, scenario, confidence FROM tscen QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY confidence DESC, severity, scenario) = 1")


@entry("r12_explain_transactions", """
SELECT h.transaction_id, concat_ws(' ', 'Flagged as ' || s.scenario || ' (confidence ' || CAST(round(s.confidence * 100, 0) AS INTEGER) || '%).',
  CASE WHEN behaviour >= 30 THEN 'Behavioural profile deviation (' || CAST(behaviour AS BIGINT) || '/100).' END,
  CASE WHEN temporal >= 20 THEN 'Temporal correlation: ' || calls_in_window || ' calls and ' || sessions_in_window || ' data sessions within the window.' END,
  CASE WHEN telecom >= 20 THEN 'Call-assisted: ' || calls_before || ' calls immediately before the transfer.' END,
  CASE WHEN internet >= 20 THEN 'Internet context (' || CAST(internet AS BIGINT) || '/100).' END) AS narrative FROM hyb h LEFT JOIN top_scen s USING (transaction_id)""")
def r12(t: Tables):
    s = scored(t)
    e = sc.explain_transactions(s, txn_scenarios(t, s))
    # the strongest-rule sentence is left out of the comparison: its points tie
    return e.select("transaction_id", F.trim(F.regexp_replace("narrative", r" ?Strongest rule: [^ ]+ \(\+\d+ pts\)\.", "")).alias("narrative"))


view("top_ascen", "SELECT account_no, scenario, confidence FROM ascen QUALIFY row_number() OVER (PARTITION BY account_no ORDER BY confidence DESC, severity, scenario) = 1")


@entry("r12_explain_accounts", """
SELECT a.account_no, concat_ws(' ', 'Account-level scenario: ' || s.scenario || ' (confidence ' || CAST(round(s.confidence * 100, 0) AS INTEGER) || '%).',
  CASE WHEN layering_depth >= 2 THEN 'Money passes on over ' || layering_depth || ' further accounts.' END, CASE WHEN circular THEN 'Part of what it sends comes back to it.' END,
  CASE WHEN shared_entities >= 3 THEN 'Shares identifiers on ' || shared_entities || ' counts.' END) AS narrative FROM acomp a LEFT JOIN top_ascen s USING (account_no)""")
def r12b(t: Tables):
    flow = cut(g.money_flow(t.bank))
    a = cp.account_composite(t.case, flow=flow, w=cp.WEIGHTS).join(t.bank.select("account_no").distinct(), "account_no", "left_semi")
    return sc.explain_accounts(a, acc_scenarios(t, flow)).select("account_no", "narrative")


@entry("r12_explain_entities", """
SELECT kind, value, CASE WHEN account_count < 3 AND NOT complained THEN 'No unusual signals detected.' ELSE concat_ws(' ', CASE WHEN account_count >= 3 THEN kind || ' ' || value || ' is shared by ' || account_count || ' accounts.' END,
  CASE WHEN complained THEN 'One of the sharing accounts is in the complaint ledger.' END) END AS narrative FROM ent""")
def r12c(t: Tables):
    return sc.explain_entities(cp.entity_composite(t.case, cp.WEIGHTS)).select("kind", "value", "narrative")


@entry("r7_weights", """SELECT 'txn' AS scope, sum(amount) AS total, round(0.30e0 * sum(amount), 2) AS rules_share FROM f_bank""")
def r7(t: Tables):
    w = cp.weights(environ={})
    return t.bank.agg(F.sum("amount").alias("total")).select(F.lit("txn").alias("scope"), "total",
                                                             F.round(F.col("total") * w["txn_rules"], 2).alias("rules_share"))


@entry("x17_bands", f"""SELECT transaction_id, {band_sql('risk_score')} AS engine, CASE WHEN risk_score >= 75 THEN 'CRITICAL' WHEN risk_score >= 50 THEN 'HIGH' WHEN risk_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS evidence,
  CASE WHEN risk_score >= 86 THEN 'SEVERE' WHEN risk_score >= 71 THEN 'CRITICAL' WHEN risk_score >= 51 THEN 'HIGH' WHEN risk_score >= 26 THEN 'MEDIUM' ELSE 'LOW' END AS result
  FROM (SELECT txn_id AS transaction_id, least(100, amount / 5000) AS risk_score FROM f_bank)""")
def x17(t: Tables):
    from weftline.functions.scoring import band
    s = F.least(F.lit(100.0), F.col("amount") / 5000)
    return t.bank.select(F.col("txn_id").alias("transaction_id"), *[band(s, k).alias(k) for k in ("engine", "evidence", "result")])
