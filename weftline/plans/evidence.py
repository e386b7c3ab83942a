"""Evidence cards, dossiers and case tables for every key at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.case import Case
from weftline.functions.clock import ist_day
from weftline.functions.ids import case_code
from weftline.functions.scoring import band, fired, is_round
from weftline.operators import aggregates as ag
from weftline.operators.aggregates import report_amount
from weftline.operators.links import any_amount, both_ends
from weftline.operators.ordering import order_statistics, values_at_most


def _round_debit():
    return F.coalesce(is_round(F.col("debit")), F.lit(False)).cast("int")


def _volumes(rows: DataFrame, key: str) -> DataFrame:
    amt = report_amount()
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("value")).agg(
        F.count(F.lit(1)).alias("transactions"), F.coalesce(F.sum("credit"), F.lit(0.0)).alias("credit"), F.coalesce(F.sum("debit"), F.lit(0.0)).alias("debit"),
        F.round(F.avg(amt), 2).alias("avg_amount"), F.max(amt).alias("max_amount"), F.sum(_round_debit()).alias("round_amounts"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


CARD = ("transactions", "calls", "ip_sessions", "credit", "debit", "avg_amount", "max_amount", "round_amounts")


def entity_cards(case: Case) -> DataFrame:
    """One row per account, phone, IMEI, IMSI, IP, UPI id and counterparty name with counts and volumes."""
    b, c, i = case.bank, case.cdr, case.ipdr
    phones = b.select("*", F.explode(F.array_distinct(F.array_compact(F.array("sender_phone", "receiver_phone")))).alias("phone"))

    def n(df, key, out):
        return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("value")).agg(F.count(F.lit(1)).alias(out))

    def card(kind, *parts):
        j = reduce(lambda x, y: x.join(y, "value", "full"), parts)
        return j.select(F.lit(kind).alias("kind"), "value", *[(F.coalesce(F.col(k), F.lit(0)) if k in j.columns else F.lit(0)).cast(
            "double" if k in ("credit", "debit", "avg_amount", "max_amount") else "long").alias(k) for k in CARD])

    cards = [card("account", _volumes(b, "account_no")), card("phone", _volumes(phones, "phone"), n(c, "a_number", "calls"), n(i, "msisdn", "ip_sessions")),
             card("imei", n(c, "imei", "calls"), n(i, "imei", "ip_sessions")), card("imsi", n(c, "imsi", "calls"), n(i, "imsi", "ip_sessions")),
             card("ip", n(i, "source_ip", "ip_sessions")), card("upi", _volumes(b, "upi_id")),
             card("name", _volumes(b.withColumn("cn", F.lower("counterparty_name")), "cn"))]
    return reduce(DataFrame.unionByName, cards)


def latest_records(events: DataFrame, top: int = 15) -> DataFrame:
    """Most recent timeline rows of every entity; the rank filter is pushed below the shuffle."""
    w = W.partitionBy("entity").orderBy(F.desc("ts"), "kind", "record_id")
    return events.where("entity is not null").select("entity", "ts", "kind", "record_id", "label", "amount").withColumn(
        "n", F.row_number().over(w)).where(F.col("n") <= top)


def call_pairs(cdr: DataFrame) -> DataFrame:
    """Call statistics of every pair of phones, both directions together, each call once."""
    g = cdr.where("a_number is not null and b_number is not null and a_number <> b_number").groupBy(
        F.least("a_number", "b_number").alias("a"), F.greatest("a_number", "b_number").alias("b")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("duration_sec").alias("total_seconds"), F.round(F.avg("duration_sec"), 1).alias("avg_seconds"),
        F.max("duration_sec").alias("max_seconds"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    burst = (F.col("calls") >= 10) & (F.col("last_ts") - F.col("first_ts") <= 3600)
    return g.withColumn("indicators", F.array_compact(F.array(F.when(burst, "CALL_BURST"))))


def money_pairs(bank: DataFrame) -> DataFrame:
    """Debit legs of every pair of accounts, net flow and indicators."""
    rows = bank.where("account_no is not null and receiver_account is not null and account_no <> receiver_account")
    fwd = F.col("account_no") < F.col("receiver_account")
    debit = F.coalesce("debit", F.lit(0.0))
    g = rows.groupBy(F.least("account_no", "receiver_account").alias("a"), F.greatest("account_no", "receiver_account").alias("b")).agg(
        F.count_if(fwd).alias("forward_count"), F.sum(F.when(fwd, debit).otherwise(0.0)).alias("forward_total"),
        F.count_if(~fwd).alias("back_count"), F.sum(F.when(~fwd, debit).otherwise(0.0)).alias("back_total"), F.sum(_round_debit()).alias("round_amounts"))
    back = F.least("forward_count", "back_count") > 0
    return g.withColumn("net", F.col("back_total") - F.col("forward_total")).withColumn("indicators", F.array_compact(F.array(
        F.when(F.col("round_amounts") > 0, "STRUCTURING"), F.when((F.greatest("forward_count", "back_count") >= 3) & back, "RETURN_FLOW"))))


def account_phone_pairs(bank: DataFrame, coincidences: DataFrame) -> DataFrame:
    """Payments and call coincidences of every account and phone seen together."""
    rows = bank.select("account_no", report_amount().alias("amt"), F.explode(F.array_distinct(F.array_compact(F.array("sender_phone", "receiver_phone")))).alias("phone"))
    g = rows.groupBy("account_no", "phone").agg(F.count(F.lit(1)).alias("payments"), F.sum("amt").alias("total"), F.max("amt").alias("largest"))
    c = coincidences.where("window_count > 0").groupBy("account_no", "phone").agg(F.count(F.lit(1)).alias("coincidences"), F.sum("window_count").alias("calls_in_window"))
    z = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return g.join(c, ["account_no", "phone"], "left").select("account_no", "phone", "payments", "total", "largest", z("coincidences"), z("calls_in_window"))


def event_dossiers(case: Case, around: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """Event with its identities, score (payments) and number and gap of the nearest events."""
    def ident(*pairs):
        return F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(k + ":"), F.col(c))) for k, c in pairs]))

    rows = (case.bank.select(F.lit("bank").alias("kind"), F.col("txn_id").alias("record_id"), "ts", F.col("account_no").alias("primary"),
                             ident(("ACCOUNT", "account_no"), ("PHONE", "sender_phone"), ("COUNTERPARTY", "receiver_account"), ("NAME", "counterparty_name")).alias("identities"))
            .unionByName(case.cdr.select(F.lit("cdr").alias("kind"), F.col("cdr_id").alias("record_id"), "ts", F.col("a_number").alias("primary"),
                                         ident(("PHONE", "a_number"), ("COUNTERPARTY", "b_number"), ("IMSI", "imsi"), ("IMEI", "imei")).alias("identities")))
            .unionByName(case.ipdr.select(F.lit("ipdr").alias("kind"), F.col("ipdr_id").alias("record_id"), F.col("start_ts").alias("ts"), F.col("source_ip").alias("primary"),
                                          ident(("SOURCE_IP", "source_ip"), ("DESTINATION_IP", "dest_ip"), ("PHONE", "msisdn")).alias("identities"))))
    near = around.groupBy("kind", "record_id").agg(F.count(F.lit(1)).alias("nearby"), F.min("gap").alias("nearest_gap"))
    out = rows.join(near, ["kind", "record_id"], "left").withColumn("nearby", F.coalesce("nearby", F.lit(0)))
    if scored is not None:
        s = scored.select(F.lit("bank").alias("kind"), F.col("transaction_id").alias("record_id"), "risk_score", "risk_band")
        out = out.join(s, ["kind", "record_id"], "left")
    return out


def account_dossiers(case: Case) -> DataFrame:
    """Turnover, receivers, linked identifiers and simple rules per account."""
    from weftline.operators.links import complained_accounts
    v = _volumes(case.bank, "account_no").withColumnRenamed("value", "account_no")
    r = case.bank.where("account_no is not null").groupBy("account_no").agg(
        F.count_distinct("receiver_account").alias("receivers"), F.count_distinct("receiver_phone").alias("phones"), F.count_distinct("upi_id").alias("upi_ids"))
    bad = complained_accounts(case.complaints).withColumn("bad", F.lit(True))
    j = v.join(r, "account_no").join(bad, "account_no", "left")
    rules = F.array_compact(F.array(F.when(F.col("bad"), "COMPLAINT"), F.when(F.col("round_amounts") > 0, "ROUND_AMOUNTS"), F.when(F.col("receivers") >= 10, "MANY_RECEIVERS")))
    return j.select("account_no", "transactions", (F.col("credit") + F.col("debit")).alias("turnover"), "receivers", "phones", "upi_ids", "first_ts", "last_ts", rules.alias("rules"))


# ---------------------------------------------------------------- case per payment

def amount_baseline(bank: DataFrame) -> DataFrame:
    """Each payment against its account: mean, median, maximum, deviation ratio, percentile."""
    rows = bank.where("account_no is not null").select("txn_id", "account_no", any_amount().alias("amt"), "date",
                                                       F.coalesce("counterparty_name", "receiver_account").alias("cp"), "credit", "debit")
    n = F.col("n")
    med = order_statistics(rows, ["account_no"], "amt", {"a": F.floor((n - 1) / 2).cast("long"), "b": F.floor(n / 2).cast("long")}).select(
        "account_no", ((F.col("a") + F.col("b")) / 2).alias("median"))
    core = rows.groupBy("account_no").agg(F.avg("amt").alias("mean"), F.max("amt").alias("largest"),
                                          F.coalesce(F.sum("credit"), F.lit(0.0)).alias("credits"), F.coalesce(F.sum("debit"), F.lit(0.0)).alias("debits"))
    breadth = rows.groupBy("account_no").agg(F.count_distinct("cp").alias("counterparties"), F.count_distinct("date").alias("active_days"))
    rank = values_at_most(rows, ["account_no"], "amt")
    j = rows.join(rank, ["account_no", "amt"]).join(med, "account_no").join(core, "account_no").join(breadth, "account_no")
    return j.where("n >= 2").select(
        "txn_id", "account_no", F.col("amt").alias("amount"), F.col("n").alias("history"), F.round("mean", 2).alias("mean"), F.round("median", 2).alias("median"),
        "largest", "credits", "debits", "counterparties", "active_days",
        F.when(F.col("median") > 0, F.round(F.col("amt") / F.col("median"), 1)).otherwise(0.0).alias("deviation_ratio"),
        F.round(F.col("at_most") / F.col("n") * 100, 1).alias("percentile"))


def counterparties(bank: DataFrame, top: int = 15) -> DataFrame:
    cp = F.coalesce("counterparty_name", "receiver_account")
    g = bank.where(F.col("account_no").isNotNull() & cp.isNotNull()).groupBy("account_no", cp.alias("counterparty")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(any_amount()).alias("total"))
    w = W.partitionBy("account_no").orderBy(F.desc("total"), "counterparty")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def funds_flow(bank: DataFrame) -> DataFrame:
    """Per payment: money into its account, money on from its receiver, and the share retained."""
    into = bank.where("credit > 0").groupBy("account_no").agg(F.count(F.lit(1)).alias("inflows"), F.sum("credit").alias("total_inflow"))
    out = bank.where("debit > 0").groupBy(F.col("account_no").alias("receiver_account")).agg(F.count(F.lit(1)).alias("outflows"), F.sum("debit").alias("total_outflow"))
    j = bank.select("txn_id", "account_no", "receiver_account", any_amount().alias("amount")).join(into, "account_no", "left").join(out, "receiver_account", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = (z("total_inflow") - z("total_outflow")) / z("total_inflow") * 100
    # scaled before it is rounded: a half may lie just below its decimal (-255.54999999999998 for -255.55)
    keep = F.when(z("total_inflow") > 0, F.round(share * 10) / 10 + 0.0).otherwise(0.0)
    return j.select("txn_id", "account_no", "receiver_account", "amount", z("inflows").alias("inflows"), z("total_inflow").cast("double").alias("total_inflow"),
                    z("outflows").alias("outflows"), z("total_outflow").cast("double").alias("total_outflow"), keep.alias("retention_pct"))


def calls_on_day(case: Case) -> DataFrame:
    """Per payment: calls of its phones on the same calendar day, and devices those phones share."""
    ends = both_ends(case.cdr.where("ts is not null"), "ts")
    per = ends.groupBy("phone", ist_day(F.col("ts")).alias("date")).agg(F.count(F.lit(1)).alias("k"))
    sides = case.bank.select("txn_id", ist_day(F.col("ts")).alias("date"), F.explode(F.array_distinct(F.array_compact(F.array("sender_phone", "receiver_phone")))).alias("phone"))
    day = sides.join(per, ["phone", "date"]).groupBy("txn_id").agg(F.sum("k").alias("calls_on_day"))
    use = case.cdr.where("imei is not null and a_number is not null").select("imei", F.col("a_number").alias("phone")).distinct()
    shared = use.join(use.groupBy("imei").agg(F.count(F.lit(1)).alias("k")).where("k >= 2"), "imei").groupBy("phone").agg(F.count(F.lit(1)).alias("d"))
    dev = sides.join(shared, "phone").groupBy("txn_id").agg(F.sum("d").alias("shared_devices"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return case.bank.select("txn_id").join(day, "txn_id", "left").join(dev, "txn_id", "left").select("txn_id", z("calls_on_day"), z("shared_devices"))


def case_evidence(case: Case, alerts: DataFrame) -> DataFrame:
    """Baseline, funds flow, telecom, complaint and quality fields per alerted payment (transaction_id, risk_score)."""
    from weftline.operators.links import with_complaint_flag
    a = alerts.select(F.col("transaction_id").alias("txn_id"), "risk_score")
    base = amount_baseline(case.bank).select("txn_id", "median", "deviation_ratio", "percentile", "history")
    j = a.join(with_complaint_flag(funds_flow(case.bank), case.complaints), "txn_id").join(base, "txn_id", "left").join(calls_on_day(case), "txn_id", "left")
    quality = case.bank.select("txn_id", (F.when(F.col("date").isNotNull(), 1).otherwise(0) + F.when(F.col("time").isNotNull(), 1).otherwise(0)
                                          + F.when(F.col("receiver_account").isNotNull(), 1).otherwise(0) + F.when(F.col("narration").isNotNull(), 1).otherwise(0)).alias("fields_present"))
    return j.join(quality, "txn_id").withColumn("case_code", case_code(F.col("txn_id")))


def red_flags(evidence: DataFrame) -> DataFrame:
    """Six red flags, five typologies and the risk driver split per case."""
    c = F.col
    ratio = F.coalesce("deviation_ratio", F.lit(0.0))

    def flag(cond, name, sev, conf):
        sev = sev if not isinstance(sev, str) else F.lit(sev)
        order = F.when(sev == "CRITICAL", 0).when(sev == "HIGH", 1).otherwise(2)
        return F.when(cond, F.struct(order.alias("o"), F.lit(name).alias("indicator"), sev.alias("severity"), (conf if not isinstance(conf, float) else F.lit(conf)).alias("confidence")))

    flags = F.array_sort(fired(
        flag(ratio >= 3, "Unusual Transaction Size", F.when(ratio >= 10, "CRITICAL").otherwise("HIGH"), F.least(F.lit(0.95), 0.5 + ratio / 50)),
        flag((c("amount") >= 5000) & (c("amount") % 5000 == 0), "Round-Number Transaction", "MEDIUM", 0.55),
        flag(c("outflows") > 0, "Rapid Movement of Funds", "HIGH", 0.75), flag(c("shared_devices") > 0, "Shared Device", "HIGH", 0.85),
        flag(c("complained"), "Fraud Complaint", "CRITICAL", 0.90), flag(c("calls_on_day") > 0, "Call Activity Near Transaction", "MEDIUM", 0.60)))
    kinds = F.array_compact(F.array(
        F.when(c("outflows") >= 2, "Layering"), F.when((c("amount") >= 5000) & (c("amount") % 5000 == 0) & (c("amount") < 50000), "Structuring"),
        F.when((c("retention_pct") < 15) & (c("outflows") > 0), "Pass-Through Account"), F.when(ratio >= 10, "Burst Activity"),
        F.when(c("shared_devices") > 0, "Shared-Device Ring")))
    s = c("risk_score")
    return evidence.select("txn_id", "case_code", flags.alias("flags"), kinds.alias("typologies"), s.alias("risk_score"), band(s, "evidence").alias("risk_band"),
                           F.round(F.least(s * 0.40, F.lit(40.0)), 1).alias("driver_ml"), F.round(F.least(s * 0.35, F.lit(35.0)), 1).alias("driver_profile"),
                           F.round(F.least(s * 0.25, F.lit(25.0)), 1).alias("driver_telecom"))


def narratives(evidence: DataFrame, flags: DataFrame) -> DataFrame:
    """Summary, findings and actions per case."""
    j = evidence.join(flags.select("txn_id", "flags", "typologies", "risk_band"), "txn_id")
    amount = F.format_string("%.0f", "amount")
    summary = F.concat(F.lit("Payment "), "txn_id", F.lit(" of Rs "), amount, F.lit(" from account "), "account_no", F.lit(" is rated "), "risk_band", F.lit("."))
    findings = F.array_compact(F.array(
        F.when(F.size("flags") > 0, F.concat(F.lit("Red flags: "), F.array_join("flags.indicator", ", "), F.lit("."))),
        F.when(F.col("outflows") > 0, F.concat(F.lit("The receiver moved money on in "), F.col("outflows").cast("string"), F.lit(" payments."))),
        F.when(F.size("typologies") > 0, F.concat(F.lit("Matches: "), F.array_join("typologies", ", "), F.lit(".")))))
    actions = F.array_compact(F.array(F.when(F.col("risk_band").isin("HIGH", "CRITICAL"), "File a report."), F.when(F.col("complained"), "Freeze the account."),
                                      F.when(F.col("calls_on_day") > 0, "Request call records.")))
    return j.select("txn_id", summary.alias("summary"), F.array_join(findings, " ").alias("findings"), F.array_join(actions, " ").alias("actions"))


# ---------------------------------------------------------------- result sets

def graph_insights(traced: DataFrame) -> DataFrame:
    """Per traced seed: edges, amount moved, largest edge, hub."""
    t = traced.groupBy("seed").agg(F.count(F.lit(1)).alias("edges"), F.sum("amount").alias("total"),
                                   F.max_by(F.concat_ws(" > ", "src", "dst"), F.struct("amount", "src", "dst")).alias("largest_edge"))
    deg = traced.select("seed", F.explode(F.array("src", "dst")).alias("node")).groupBy("seed", "node").agg(F.count(F.lit(1)).alias("k"))
    hub = deg.groupBy("seed").agg(F.min_by("node", F.struct(-F.col("k"), "node")).alias("hub"))
    return t.join(hub, "seed")


def result_summary(rows: DataFrame, set_key: str) -> DataFrame:
    """Count, total, span, modes, accounts and night share of every result set of payments."""
    hour = F.substring("time", 1, 2)
    return rows.groupBy(set_key).agg(
        F.count(F.lit(1)).alias("records"), F.sum("amount").alias("total"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.array_join(F.sort_array(F.collect_set("mode")), ",").alias("modes"), F.round(F.avg(((hour >= "22") | (hour < "06")).cast("int")), 4).alias("night_share")
    ).join(rows.groupBy(set_key).agg(F.count_distinct("account_no").alias("accounts"), F.count_distinct("receiver_account").alias("beneficiaries")), set_key)


def result_intelligence(rows: DataFrame, set_key: str) -> DataFrame:
    """Primary account, most repeated beneficiary and most common phone of every result set."""
    best = None
    for col, out in (("account_no", "primary_account"), ("receiver_account", "top_beneficiary"), ("receiver_phone", "common_phone")):
        k = rows.where(F.col(col).isNotNull()).groupBy(set_key, col).agg(F.count(F.lit(1)).alias("k")).groupBy(set_key).agg(
            F.min_by(col, F.struct(-F.col("k"), col)).alias(out))
        best = k if best is None else best.join(k, set_key, "full")
    return best


def top_leads(rows: DataFrame, set_key: str, top: int = 5) -> DataFrame:
    """Strongest rows of every result set with their two heaviest rules."""
    w = W.partitionBy(set_key).orderBy(F.desc("risk_score"), "transaction_id")
    rules = F.transform(F.slice(F.reverse(F.array_sort(F.transform("breakdown", lambda b: F.struct(b["points"].alias("p"), b["rule"].alias("r"))))), 1, 2), lambda x: x["r"])
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top).select(set_key, "n", "transaction_id", "amount", "risk_score", rules.alias("why"))


def activity_bundle(case: Case) -> DataFrame:
    """Per phone: payments, calls, sessions, money in and out, and a one-line audit."""
    sides = case.bank.select(F.explode(F.array_distinct(F.array_compact(F.array("sender_phone", "receiver_phone")))).alias("phone"), "credit", "debit")
    pay = sides.groupBy("phone").agg(F.count(F.lit(1)).alias("payments"), F.coalesce(F.sum("credit"), F.lit(0.0)).alias("credit"), F.coalesce(F.sum("debit"), F.lit(0.0)).alias("debit"))
    calls = both_ends(case.cdr).groupBy("phone").agg(F.count(F.lit(1)).alias("calls"))
    sess = case.ipdr.where("msisdn is not null").groupBy(F.col("msisdn").alias("phone")).agg(F.count(F.lit(1)).alias("sessions"))
    j = pay.join(calls, "phone", "full").join(sess, "phone", "full")
    z = lambda c, t="long": F.coalesce(F.col(c), F.lit(0)).cast(t)
    audit = F.concat(z("payments").cast("string"), F.lit(" payments, "), z("calls").cast("string"), F.lit(" calls, "), z("sessions").cast("string"), F.lit(" sessions"))
    return j.select("phone", z("payments").alias("payments"), z("calls").alias("calls"), z("sessions").alias("sessions"), z("credit", "double").alias("credit"),
                    z("debit", "double").alias("debit"), audit.alias("audit"))
