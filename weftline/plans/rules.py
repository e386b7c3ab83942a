"""Deterministic scoring: payment behaviour, account and phone heat, shared identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.case import Case
from weftline.functions.clock import has_clock, ist_day, odd_hour
from weftline.functions.scoring import band, capped_sum, confidence, fired, is_call, is_round, rule
from weftline.operators.bands import band_pairs
from weftline.operators.context import payment_context
from weftline.operators.features import customer_key, daily_rates
from weftline.operators.links import any_amount, both_ends, complained_accounts
from weftline.operators.ordering import with_scalars
from weftline.session import cut

NOISE_CEILING = 0.25
HOUR, HALF_HOUR, TWO_DAYS = 3600, 1800, 48 * 3600


def family_weight(prevalence: Column) -> Column:
    """Full weight while a rule is rare, fading to 0.2 as it becomes the norm."""
    return F.when(prevalence <= NOISE_CEILING, 1.0).otherwise(
        F.greatest(F.lit(0.2), (1.0 - prevalence) / (1.0 - NOISE_CEILING)))


def _points(case: Case) -> DataFrame:
    return (case.bank.where("ts is not null and sender_phone is not null")
            .select(F.col("sender_phone").alias("phone"), "ts").distinct())


WHAT = ("novel_imei", "rare_imei", "novel_pair")


def _span_hits(points: DataFrame, spans: DataFrame, reach: int) -> DataFrame:
    """Smallest value of each kind whose span covers a (phone, ts); spans are at most ``reach`` long.

    Spans exist only per distinct phone and value and points are distinct seconds, so the pairs that
    stream through the aggregation are bounded by values times seconds, not by rows.
    """
    events = spans.where("hi >= lo").select("phone", F.col("lo").alias("__ets"), "hi", "value", "what")
    hits = band_pairs(points, events, ["phone"], -reach, 0).where(F.col("ts") <= F.col("hi"))
    return hits.groupBy("phone", "ts").agg(*[F.min(F.when(F.col("what") == w, F.col("value"))).alias(w) for w in WHAT])


def _occurrences(case: Case) -> DataFrame:
    """First, second and third time of every device, and SIM with device, of a phone in calls and sessions."""
    def rows(df, phone, ts, src, rid):
        pair = F.when(F.col("imsi").isNotNull() & F.col("imei").isNotNull(), F.concat_ws("/", "imsi", "imei"))
        kinds = F.array(F.struct(F.lit("imei").alias("what"), F.col("imei").alias("value")),
                        F.struct(F.lit("pair").alias("what"), pair.alias("value")))
        return (df.where(F.col(phone).isNotNull() & F.col(ts).isNotNull())
                .select(F.col(phone).alias("phone"), F.col(ts).alias("ts"), F.lit(src).alias("src"), F.col(rid).alias("id"),
                        F.explode(kinds).alias("k")).select("phone", "ts", "src", "id", "k.*").where("value is not null"))

    both = rows(case.cdr, "a_number", "ts", "c", "cdr_id").unionByName(rows(case.ipdr, "msisdn", "start_ts", "s", "ipdr_id"))
    # the first three rows are all that matters; the ranking filter is pushed below the shuffle
    w = W.partitionBy("phone", "what", "value", "src").orderBy("ts", "id")
    top = both.withColumn("n", F.row_number().over(w)).where("n <= 3")
    pick = lambda s, n: F.max(F.when((F.col("src") == s) & (F.col("n") == n), F.col("ts"))).alias(f"{s}{n}")
    return top.groupBy("phone", "what", "value").agg(*[pick(s, n) for s in "cs" for n in (1, 2, 3)])


def device_novelty(case: Case) -> DataFrame:
    """(phone, ts, novel_imei, rare_imei, novel_pair) for payment moments.

    * novel device: first used within the hour after (calls) or half hour (sessions), at most twice before;
    * rare device: at most two records in the whole case, used within the hour after;
    * novel pair: SIM and device first seen in calls within the hour after with at most two sessions before,
      or used in calls within two days, never before in sessions and at most twice before in calls. Only a
      pair's first three calls can open such a span, hence at most four spans per pair.
    """
    o = _occurrences(case)

    def span(rows, lo, hi, what):
        return rows.select("phone", lo.alias("lo"), hi.alias("hi"), "value", F.lit(what).alias("what"))

    c = F.col
    dev, pair = o.where("what = 'imei'"), o.where("what = 'pair'")
    seen = case.cdr.select("imei").unionByName(case.ipdr.select("imei")).where("imei is not null")
    rare = seen.groupBy("imei").agg(F.count(F.lit(1)).alias("k")).where("k <= 2")
    rare_rows = case.cdr.where("a_number is not null and ts is not null").join(rare, "imei").select(
        c("a_number").alias("phone"), "ts", c("imei").alias("value")).distinct()
    near = [span(dev.where("c1 is not null"), c("c1") - HOUR, F.least("c1", F.coalesce("s3", "c1")), "novel_imei"),
            span(dev.where("s1 is not null"), c("s1") - HALF_HOUR, F.least("s1", F.coalesce("c3", "s1")), "novel_imei"),
            span(rare_rows, c("ts") - HOUR, c("ts"), "rare_imei"),
            span(pair.where("c1 is not null"), c("c1") - HOUR, F.least("c1", F.coalesce("s3", "c1")), "novel_pair")]
    far = []
    for n in ("c1", "c2", "c3"):
        stop = c(n) + TWO_DAYS
        far.append(span(pair.where(c(n).isNotNull()), c(n) - TWO_DAYS, F.least(stop, F.coalesce("c3", stop), F.coalesce("s1", stop)), "novel_pair"))
    points = _points(case)
    return _span_hits(points, reduce(DataFrame.unionByName, near), HOUR).unionByName(
        _span_hits(points, reduce(DataFrame.unionByName, far), 2 * TWO_DAYS)).groupBy("phone", "ts").agg(
        *[F.min(w).alias(w) for w in WHAT])


def _day_calls(case: Case) -> DataFrame:
    """Per payment: calls of either phone on the payment's own calendar day (date-only ledgers)."""
    ends = both_ends(case.cdr.where("ts is not null").where(is_call(F.col("call_type"), F.col("duration_sec"))), "ts")
    per_day = ends.groupBy("phone", ist_day(F.col("ts")).alias("date")).agg(F.count(F.lit(1)).alias("k"))
    sides = case.bank.select("txn_id", "date", F.explode(F.array_compact(F.array("sender_phone", "receiver_phone"))).alias("phone"))
    return sides.join(per_day, ["phone", "date"]).groupBy("txn_id").agg(F.sum("k").alias("day_calls"))


def rule_inputs(case: Case, context: DataFrame | None = None) -> DataFrame:
    """Every payment with the values its rules look at. Written once: weights and rules both read it."""
    rows = context if context is not None else payment_context(case)
    rows = rows.join(daily_rates(case.bank), ["customer", "date"], "left").join(_day_calls(case), "txn_id", "left")
    rows = rows.join(device_novelty(case).withColumnRenamed("phone", "sender_phone"), ["sender_phone", "ts"], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    moved = F.coalesce((F.col("new_cells") > 0) & (F.col("first_cell_ts") < F.col("ts")), F.lit(False))
    return cut(rows.select(
        "txn_id", "customer", "account_no", "bank", "mode", "ts", "date", "time", "receiver_account", "sender_phone",
        F.round(any_amount(), 2).alias("amount"), "prior_n", "first_beneficiary", "velocity", "median_upper",
        "hour_mode", "day_median", z("day_count"), "calls_hour", "long_calls_hour", "sessions_near", z("day_calls"),
        *WHAT, moved.alias("moved"), (~moved & (F.col("rare_cells") > 0)).alias("rare_cell"),
        "hour", has_clock(F.col("time")).alias("clock")))


def rule_prevalence(rows: DataFrame, bank: DataFrame) -> DataFrame:
    """One row: share of payments on which each rule family would fire, turned into weights."""
    share = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0.0))
    phone = F.col("sender_phone").isNotNull() & F.col("ts").isNotNull()
    p = rows.agg(
        share(odd_hour(F.col("hour"))).alias("odd"),
        share(F.col("first_beneficiary") & (F.col("prior_n") >= 1)).alias("ben"),
        share(phone & (F.col("long_calls_hour") >= 1)).alias("calls"),
        share(phone & (F.col("sessions_near") >= 1)).alias("net"),
        share((F.col("hour") >= 0) & (F.col("prior_n") >= 1) & (F.abs(F.col("hour") - F.col("hour_mode")) >= 6)).alias("hdev"),
        (F.coalesce(F.avg(F.col("clock").cast("int")), F.lit(1.0)) < 0.5).alias("day_granular"))
    return p.select(*[family_weight(F.col(c)).alias(f"w_{c}") for c in ("odd", "ben", "calls", "net", "hdev")], "day_granular")


def payment_rules(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Fourteen behavioural rules with points and prevalence weights, capped at 100."""
    r = with_scalars(rows, weights, "w")
    w = lambda n: F.col("w")[f"w_{n}"]
    daily = F.col("w")["day_granular"]
    prior, hour, amt, base = F.col("prior_n"), F.col("hour"), F.col("amount"), F.col("median_upper")
    ratio = F.when((base > 0) & (amt > 0), amt / base)
    spike = (F.when((ratio >= 8) & (prior >= 3), 40).when((ratio >= 5) & (prior >= 5), 30)
             .when((ratio >= 3) & (prior >= 10), 20).when((ratio >= 2) & (prior >= 3), 15))
    day_base = F.greatest(F.lit(1.0), F.coalesce("day_median", F.lit(1.0)))
    n_day, burst = F.col("day_count"), F.col("velocity")
    velocity = (F.when(daily & (n_day >= F.greatest(5 * day_base, F.lit(12.0))), 50)
                .when(daily & (n_day >= F.greatest(2.5 * day_base, F.lit(6.0))), 25)
                .when(~daily & (burst >= 6), 50).when(~daily & (burst >= 4), 25))
    new_ben = F.col("first_beneficiary") & F.col("receiver_account").isNotNull()
    calls, clock = F.col("calls_hour"), F.col("clock")
    day_form = ~clock & daily
    call_pts = F.when(clock & (calls >= 3), 40).when(day_form & (F.col("day_calls") >= 2), 25)
    one_call = F.when(clock & (calls >= 1) & (calls < 3), 30).when(day_form & (F.col("day_calls") == 1), 15)
    online = clock & F.col("sender_phone").isNotNull()
    device = F.when(F.col("novel_imei").isNotNull(), 30).when(F.col("rare_imei").isNotNull(), 15)
    place = F.when(F.col("moved"), 30).when(F.col("rare_cell"), 15)
    rules = fired(
        rule(odd_hour(hour), "ODD_HOUR_TRANSACTION", F.when(prior >= 3, 30).otherwise(10), "outside normal banking hours", w("odd")),
        rule((hour >= 0) & (prior >= 1) & (F.abs(hour - F.col("hour_mode")) >= 6), "CUSTOMER_HOUR_DEVIATION",
             F.when(prior >= 3, 20).otherwise(10), "far from the customer's usual hour", w("hdev")),
        rule(spike.isNotNull(), "CUSTOMER_RELATIVE_AMOUNT_SPIKE", spike,
             F.concat(F.format_string("%.1f", ratio), F.lit("x the customer's median"))),
        rule(velocity.isNotNull(), "AMOUNT_VELOCITY_SPIKE", velocity, "unusual number of payments in a short time"),
        rule(new_ben & (prior >= 1), "NEW_BENEFICIARY", F.when(prior >= 5, 25).otherwise(10), "first transfer to this beneficiary", w("ben")),
        rule(is_round(amt), "ROUND_AMOUNT", 10, "round payout"),
        rule(call_pts.isNotNull(), "REPEATED_CALLS_BEFORE_TRANSACTION", call_pts, "several calls shortly before", w("calls")),
        rule(one_call.isNotNull(), "UNUSUAL_CALL_BEFORE_TRANSACTION", one_call, "a call shortly before", w("calls")),
        rule(clock & (calls >= 1) & new_ben, "CALL_THEN_NEW_BENEFICIARY", 20, "call before a first-time transfer", w("calls")),
        rule(clock & (calls >= 1) & (base > 0) & (amt >= 3 * base), "CALL_THEN_HIGH_VALUE_TRANSFER", 25,
             "call before a high-value transfer", w("calls")),
        rule(online & (F.col("sessions_near") >= 3), "NETWORK_SESSION_BURST_AROUND_TRANSACTION", 30, "data sessions around payment", w("net")),
        rule(online & device.isNotNull(), "NEW_DEVICE_AROUND_TRANSACTION", device, "device new or rare", w("net")),
        rule(online & F.col("novel_pair").isNotNull(), "IMSI_IMEI_PAIR_NOVELTY", 35, "SIM and device combination new", w("net")),
        rule(online & place.isNotNull(), "UNUSUAL_LOCATION_CONTEXT", place, "phone at an unfamiliar cell", w("net")))
    r = r.withColumn("breakdown", rules)
    r = r.withColumn("risk_score", capped_sum(F.col("breakdown")))
    return r.select(F.col("txn_id").alias("transaction_id"), "customer", "account_no", "amount", "mode", "bank", "ts",
                    "risk_score", band(F.col("risk_score"), "behaviour").alias("risk_band"),
                    F.col("breakdown.rule").alias("rules_fired"), "breakdown", confidence(F.col("risk_score")).alias("confidence"))


def behaviour_scores(case: Case, context: DataFrame | None = None) -> DataFrame:
    rows = rule_inputs(case, context)
    return payment_rules(rows, rule_prevalence(rows, case.bank))


# ---------------------------------------------------------------- heat

def account_heat(case: Case) -> DataFrame:
    """Complaint, channel, volume, breadth and telecom rules per account."""
    rows = case.bank.where("account_no is not null")
    core = rows.groupBy("account_no").agg(
        F.min("bank").alias("bank"), F.count(F.lit(1)).alias("txns"), F.coalesce(F.sum("credit"), F.lit(0.0)).alias("credit"),
        F.coalesce(F.sum("debit"), F.lit(0.0)).alias("debit"),
        F.sum((F.col("mode") == "UPI").cast("int")).alias("upi"))
    names = rows.groupBy("account_no").agg(F.count_distinct(F.substring("counterparty_name", 1, 40)).alias("names"))
    phones = rows.select("account_no", F.coalesce("receiver_phone", "sender_phone").alias("phone")).where(
        "phone is not null").distinct()
    callers = case.cdr.where("a_number is not null").select(F.col("a_number").alias("phone")).distinct().withColumn(
        "calls", F.lit(True))
    ph = phones.join(callers, "phone", "left").groupBy("account_no").agg(
        F.count(F.lit(1)).alias("phones"), F.max("calls").alias("in_calls"))
    ledger = case.complaints.where("account_no is not null").groupBy("account_no").agg(
        F.count(F.lit(1)).alias("complaints"), F.sort_array(F.collect_set("state")).alias("states"))
    j = core.join(names, "account_no", "left").join(ph, "account_no", "left").join(ledger, "account_no", "left")
    t = F.col("txns")
    rules = fired(
        rule(F.col("complaints").isNotNull(), "COMPLAINED_ACCOUNT", 60, "account is in the complaint ledger"),
        rule((F.col("upi") > 0) & (F.col("upi") >= t * 0.8) & (t >= 10), "UPI_HEAVY", 10, "at least 80% UPI"),
        rule((F.col("credit") >= 100000) & (t >= 10), "HIGH_VOLUME", 10, "credits of 100,000 or more"),
        rule((F.col("names") >= 15) & (t >= 25), "MANY_COUNTERPARTIES", 15, "many distinct counterparties"),
        rule(F.col("phones") >= 5, "MANY_PHONES", 10, "many phone numbers"),
        rule(F.coalesce("in_calls", F.lit(False)), "PHONE_IN_CALLS", 20, "account phone appears in call records"))
    j = j.withColumn("breakdown", rules).withColumn("score", capped_sum(F.col("breakdown")))
    return j.select("account_no", "bank", "txns", "credit", "debit", "score", F.col("breakdown.rule").alias("flags"),
                    "breakdown", confidence(F.col("score")).alias("confidence"),
                    F.coalesce("states", F.array().cast("array<string>")).alias("states"))


def phone_heat(cdr: DataFrame) -> DataFrame:
    from weftline.operators.aggregates import phone_profiles
    p = phone_profiles(cdr)
    span = F.coalesce(F.col("last_ts") - F.col("first_ts"), F.lit(0))
    rules = fired(
        rule(F.col("records") >= 50, "HIGH_ACTIVITY", 15, "heavy activity"),
        rule(F.col("unique_contacts") >= 25, "MANY_CONTACTS", 15, "many contacts"),
        rule(span > 60 * 86400, "LONG_ACTIVITY_SPAN", 5, "active for more than 60 days"))
    p = p.withColumn("breakdown", rules).withColumn("score", capped_sum(F.col("breakdown")))
    return p.select("phone", "records", "unique_contacts", "sms", "voice", "score", F.col("breakdown.rule").alias("flags"),
                    "breakdown", confidence(F.col("score")).alias("confidence"))


# ---------------------------------------------------------------- shared identifiers

def identifier_accounts(case: Case) -> DataFrame:
    """Distinct (kind, value, account) over payments and, through phones, over calls and sessions."""
    b = case.bank.withColumn("account", F.coalesce("account_no", "customer_id")).where("account is not null")
    pairs = [F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (
        ("phone", "sender_phone"), ("phone", "receiver_phone"), ("upi", "upi_id"), ("beneficiary", "receiver_account"))]
    pairs.append(F.struct(F.lit("customer").alias("kind"), customer_key().alias("value")))
    pay = (b.select("account", F.explode(F.array(*pairs)).alias("p")).select("p.kind", "p.value", "account")
           .where("value is not null").distinct())
    owner = pay.where("kind = 'phone'").select(F.col("value").alias("phone"), "account")
    dev = (case.cdr.where("a_number is not null").select(F.col("a_number").alias("phone"), F.explode(F.array(
        F.struct(F.lit("imei").alias("kind"), F.col("imei").alias("value")),
        F.struct(F.lit("imsi").alias("kind"), F.col("imsi").alias("value")))).alias("p"))
        .unionByName(case.ipdr.where("msisdn is not null").select(F.col("msisdn").alias("phone"), F.explode(F.array(
            F.struct(F.lit("imsi").alias("kind"), F.col("imsi").alias("value")),
            F.struct(F.lit("ip").alias("kind"), F.col("source_ip").alias("value")))).alias("p")))
        .select("phone", "p.kind", "p.value").where("value is not null").distinct())
    via = dev.join(owner, "phone", "left").select("kind", "value", F.coalesce("account", "phone").alias("account"))
    return pay.unionByName(via).distinct()


def entity_risk(case: Case) -> DataFrame:
    """Identifiers used by several accounts: 25 points an account (12 or more: 100), complaint +25."""
    ids = identifier_accounts(case)
    bad = complained_accounts(case.complaints).select(F.col("account_no").alias("account"), F.lit(True).alias("bad"))
    agg = ids.join(bad, "account", "left").groupBy("kind", "value").agg(
        F.count(F.lit(1)).alias("account_count"), F.coalesce(F.max("bad"), F.lit(False)).alias("complained"))
    agg = agg.where("account_count >= 2")
    k = F.col("account_count")
    conc = F.when(k >= 12, 100.0).otherwise(F.least(F.lit(100.0), 25.0 * k))
    reasons = F.array_compact(F.array(
        F.when(k >= 3, F.concat(F.lit("shared by "), k.cast("string"), F.lit(" accounts"))),
        F.when(k >= 6, F.lit("high fan-out")), F.when(F.col("kind") == "phone", F.lit("phone fan-out")),
        F.when(F.col("complained"), F.lit("account in complaint ledger"))))
    return agg.select("kind", "value", "account_count", "complained",
                      F.least(F.lit(100.0), conc + F.when(F.col("complained"), 25.0).otherwise(0.0)).alias("entity_risk"),
                      reasons.alias("reasons"))


def entity_exposure(case: Case, entities: DataFrame | None = None) -> DataFrame:
    """Per account: 0.4 times the worst plus 0.35 times the mean risk of its shared identifiers."""
    e = entities if entities is not None else entity_risk(case)
    a = identifier_accounts(case).join(e.select("kind", "value", "entity_risk"), ["kind", "value"])
    g = a.groupBy(F.col("account").alias("account_no")).agg(
        F.max("entity_risk").alias("mx"), F.avg("entity_risk").alias("mean"), F.count(F.lit(1)).alias("shared_entities"),
        F.count_distinct("kind").alias("entity_kinds"))
    return g.select("account_no", F.round(F.least(F.lit(100.0), 0.4 * F.col("mx") + 0.35 * F.col("mean")), 2)
                    .alias("entity_risk"), "shared_entities", "entity_kinds")


def entity_stats(entities: DataFrame) -> DataFrame:
    return entities.groupBy("kind").agg(
        F.count(F.lit(1)).alias("entity_count"), F.sum((F.col("entity_risk") >= 25).cast("int")).alias("flagged_count"),
        F.max("account_count").alias("max_share"))
