"""Profiles, registries and report aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.case import Case
from weftline.functions.clock import utc_hour, weekday
from weftline.functions.ids import JUNK_IDS
from weftline.operators.links import any_amount
from weftline.operators.ordering import linear_quantiles, with_scalars

# Order in which payment modes are listed.
MODE_ORDER = ("UPI", "IMPS", "NEFT", "RTGS", "ATM", "POS", "CHEQUE", "CASH", "MBB", "NACH", "ECS", "OTHER")


def report_amount() -> Column:
    """Credit when there is one, else debit, else zero."""
    return F.coalesce(F.when(F.col("credit") != 0, F.col("credit")), F.col("debit"), F.lit(0.0))


def top_counts(rows: DataFrame, key: str, value: Column, k: int, out: str) -> DataFrame:
    """Per key: array of the k most frequent values with counts (ties: smallest value)."""
    counted = rows.select(key, value.alias("v")).where("v is not null and v <> ''").groupBy(key, "v").agg(
        F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(key).orderBy(F.desc("n"), "v")
    return (counted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy(key)
            .agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("r", "v", "n"))),
                                                lambda x: F.struct(x["v"], x["n"]))).alias(out)))


def phone_profiles(cdr: DataFrame) -> DataFrame:
    rows = cdr.where("a_number is not null")
    sms = F.contains(F.upper(F.coalesce("call_type", F.lit(""))), F.lit("SMS"))
    core = rows.groupBy(F.col("a_number").alias("phone")).agg(
        F.count(F.lit(1)).alias("records"), F.sum(sms.cast("int")).alias("sms"), F.sum((~sms).cast("int")).alias("voice"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    contacts = rows.groupBy(F.col("a_number").alias("phone")).agg(F.count_distinct("b_number").alias("unique_contacts"))
    return core.join(contacts, "phone")


def phone_towers(cdr: DataFrame, k: int = 5) -> DataFrame:
    rows = cdr.where("a_number is not null").withColumnRenamed("a_number", "phone")
    return top_counts(rows, "phone", F.coalesce("cell_id_first", "cell_id_last"), k, "towers")


def account_profiles(bank: DataFrame, complaints: DataFrame) -> DataFrame:
    """Counts, flows, most used modes, counterparties, phones and UPI ids, complaints per account."""
    rows = bank.where("account_no is not null")
    core = rows.groupBy("account_no").agg(
        F.min("bank").alias("bank"), F.count(F.lit(1)).alias("txns"), F.coalesce(F.sum("credit"), F.lit(0.0)).alias("credit"),
        F.coalesce(F.sum("debit"), F.lit(0.0)).alias("debit"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    for value, k, out in ((F.coalesce("mode", F.lit("OTHER")), 6, "modes"),
                          (F.substring(F.trim("counterparty_name"), 1, 40), 8, "counterparties"),
                          (F.coalesce("receiver_phone", "sender_phone"), 8, "phones"), (F.col("upi_id"), 8, "upi_ids")):
        core = core.join(top_counts(rows, "account_no", value, k, out), "account_no", "left")
    c = complaints.where("account_no is not null").groupBy("account_no").agg(
        F.count(F.lit(1)).alias("complaints"), F.sort_array(F.collect_set("state")).alias("states"))
    return core.join(c, "account_no", "left").withColumn("complaints", F.coalesce("complaints", F.lit(0)))


def entity_registry(case: Case) -> DataFrame:
    """Every identifier with its record count, count per role and sources."""
    def rows(df, kind, col, role, source):
        v = F.trim(F.col(col).cast("string"))
        keep = v.isNotNull() & ~v.isin(*JUNK_IDS)
        return df.where(keep).select(F.lit(kind).alias("kind"), v.alias("value"), F.lit(role).alias("role"),
                                     F.lit(source).alias("source"))

    def name(df, col, source):
        v = F.trim(F.col(col))
        return df.where(v.isNotNull() & (v != "") & (F.length(v) < 60)).select(
            F.lit("name").alias("kind"), F.lower(v).alias("value"), F.lit("name").alias("role"), F.lit(source).alias("source"))

    b, c, i, s, x = case.bank, case.cdr, case.ipdr, case.subscribers, case.complaints
    parts = [
        rows(b, "account", "account_no", "account", "bank"), rows(x, "account", "account_no", "complaint", "complaint"),
        rows(b, "phone", "sender_phone", "bank_sender", "bank"), rows(b, "phone", "receiver_phone", "bank_receiver", "bank"),
        rows(c, "phone", "a_number", "cdr_a", "cdr"), rows(c, "phone", "b_number", "cdr_b", "cdr"),
        rows(i, "phone", "msisdn", "ipdr", "ipdr"), rows(s, "phone", "msisdn", "subscriber", "subscriber"),
        rows(x, "phone", "mobile", "complaint_mobile", "complaint"), rows(b, "upi", "upi_id", "upi", "bank"),
        rows(c, "imei", "imei", "imei", "cdr"), rows(s, "imei", "imei", "imei", "subscriber"),
        rows(c, "imsi", "imsi", "imsi", "cdr"), rows(s, "imsi", "imsi", "imsi", "subscriber"),
        rows(i, "ip", "source_ip", "ip", "ipdr"), name(b, "counterparty_name", "bank"),
        name(s, "subscriber_name", "subscriber"),
    ]
    if "police_station" in x.columns:
        parts.append(name(x, "police_station", "complaint"))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    per_role = long.groupBy("kind", "value", "role", "source").agg(F.count(F.lit(1)).alias("n"))
    counted = F.when(~((F.col("kind") == "account") & (F.col("role") == "complaint")), F.col("n")).otherwise(0)
    return per_role.groupBy("kind", "value").agg(
        F.sum(counted).alias("count"),
        F.sort_array(F.collect_list(F.struct("role", "source", "n"))).alias("roles"),
        F.sort_array(F.collect_set("source")).alias("sources"))


def mode_counts(bank: DataFrame) -> DataFrame:
    mode = F.coalesce("mode", F.lit("OTHER"))
    mode = F.when(mode.isin(*MODE_ORDER), mode).otherwise("OTHER")
    out = bank.groupBy(mode.alias("mode")).agg(F.count(F.lit(1)).alias("txns"), F.sum(any_amount()).alias("amount"))
    rank = F.array_position(F.array(*map(F.lit, MODE_ORDER)), F.col("mode"))
    return out.withColumn("position", rank.cast("int"))


def account_hour_heatmap(bank: DataFrame, account: str | None = None, top: int = 30) -> DataFrame:
    """(account, hour) cells of the accounts that moved most."""
    rows = bank.where("ts is not null")
    if account:
        rows = rows.where(F.col("account_no") == account)
    cells = rows.groupBy("account_no", utc_hour(F.col("ts")).alias("hour")).agg(
        F.count(F.lit(1)).alias("txns"), F.sum(any_amount()).alias("amount"))
    best = cells.groupBy("account_no").agg(F.sum("amount").alias("moved")).orderBy(F.desc("moved"), "account_no").limit(top)
    return cells.join(best.select("account_no"), "account_no", "left_semi")


def activity_levels(bank: DataFrame) -> DataFrame:
    """Hour, weekday and weekday-by-hour activity in one pass."""
    rows = bank.where("ts is not null").select(
        utc_hour(F.col("ts")).alias("hour"), weekday(F.col("ts")).alias("weekday"), report_amount().alias("amt"), "credit", "debit")
    g = rows.groupingSets([[F.col("hour")], [F.col("weekday")], [F.col("weekday"), F.col("hour")]],
                          F.col("weekday"), F.col("hour"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).alias(c + "s")
    out = g.agg(F.count(F.lit(1)).alias("txns"), F.sum("amt").alias("amount"), zero("credit"), zero("debit"),
                F.grouping_id().alias("g"))
    # grouping id bits: weekday, hour; a set bit means the column is rolled up
    level = F.element_at(F.array(*map(F.lit, ("weekday_hour", "weekday", "hour"))), (F.col("g") + 1).cast("int"))
    return out.select(level.alias("level"), F.coalesce("weekday", F.lit(-1)).alias("weekday"),
                      F.coalesce("hour", F.lit(-1)).alias("hour"), "txns", "amount", "credits", "debits")


def day_hour_risk(bank: DataFrame, heat: DataFrame) -> DataFrame:
    """Weekday by hour cells with mean account heat (25 where unknown, at least 55 from 23:00 to 05:00)."""
    rows = bank.where("ts is not null").groupBy(
        "account_no", weekday(F.col("ts")).alias("weekday"), utc_hour(F.col("ts")).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(report_amount()).alias("amt"))
    j = rows.join(heat.select("account_no", "score"), "account_no", "left")
    base = F.coalesce("score", F.lit(25.0))
    risk = F.when(F.col("hour").isin(23, 0, 1, 2, 3, 4), F.greatest(base, F.lit(55.0))).otherwise(base)
    g = j.groupBy("weekday", "hour").agg(F.sum("n").alias("txns"), F.sum("amt").alias("amount"),
                                         (F.sum(risk * F.col("n")) / F.sum("n")).alias("mean"))
    mean = F.round("mean", 1)
    return g.select("weekday", "hour", "txns", "amount", mean.alias("risk_score"),
                    F.round(F.least(F.lit(100.0), F.col("txns") * 8 + mean * 0.6), 1).alias("intensity"))


def amount_histogram(bank: DataFrame, buckets: int = 8) -> DataFrame:
    """Buckets of equal ratio between the smallest and largest positive amount."""
    rows = bank.select(report_amount().alias("amt")).where("amt > 0")
    ends = rows.agg(F.min("amt").alias("lo"), F.max("amt").alias("hi"))
    s = F.col("scalars")
    pos = F.log(F.col("amt") / s["lo"]) / F.log(s["hi"] / s["lo"]) * buckets
    idx = F.when(s["hi"] > s["lo"], F.least(F.floor(pos), F.lit(buckets - 1))).otherwise(0)
    return with_scalars(rows, ends).groupBy(idx.cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("txns"), F.sum("amt").alias("amount"))


def session_hours(ipdr: DataFrame) -> DataFrame:
    mb = (F.coalesce("volume_up", F.lit(0)) + F.coalesce("volume_down", F.lit(0))) / 1000000.0
    return ipdr.where("start_ts is not null").groupBy(utc_hour(F.col("start_ts")).alias("hour")).agg(
        F.count(F.lit(1)).alias("sessions"), F.round(F.sum(mb), 2).alias("mb"))


def shared_by(rows: DataFrame, key: str, member: str, at_least: int = 2, top: int = 40, shown: int = 8) -> DataFrame:
    """Keys with several distinct members, most shared first; member lists are cut by rank before collecting."""
    pairs = rows.where(F.col(key).isNotNull() & F.col(member).isNotNull()).groupBy(key, member).agg(
        F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(key).orderBy(member)
    head = pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= shown).groupBy(key).agg(
        F.sort_array(F.collect_list(member)).alias("members"))
    tot = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("member_count"), F.sum("n").alias("records"))
    best = tot.where(F.col("member_count") >= at_least).orderBy(F.desc("member_count"), F.desc("records"), key).limit(top)
    return best.join(head, key)


def phone_reuse(bank: DataFrame, top: int = 40) -> DataFrame:
    return shared_by(bank, "receiver_phone", "account_no", 1, top)


def bank_matrix(bank: DataFrame, top: int = 30) -> DataFrame:
    """Bank-to-bank volume; an unknown side stays OTHER."""
    from weftline.functions.narration import bank_code
    a = bank_code(F.col("bank"))
    b = bank_code(F.col("counterparty_bank"))
    return (bank.groupBy(a.alias("sender_bank"), b.alias("receiver_bank"))
            .agg(F.count(F.lit(1)).alias("txns"), F.sum(any_amount()).alias("amount"))
            .orderBy(F.desc("amount"), "sender_bank", "receiver_bank").limit(top))


def circle_activity(case: Case) -> DataFrame:
    c = case.cdr.where("roaming_circle is not null").groupBy(F.col("roaming_circle").alias("circle")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum((F.col("duration_sec") > 300).cast("int")).alias("long_calls"))
    i = case.ipdr.where("roaming_circle is not null").groupBy(F.col("roaming_circle").alias("circle")).agg(
        F.count(F.lit(1)).alias("sessions"))
    z = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return c.join(i, "circle", "full").select("circle", z("calls"), z("long_calls"), z("sessions"))


# Expected share of each first digit, in percent.
FIRST_DIGIT_PERCENT = (30.1, 17.6, 12.5, 9.7, 7.9, 6.7, 5.8, 5.1, 4.6)


def benford(bank: DataFrame) -> DataFrame:
    """First digits of amounts of 10 and more against the logarithmic law, chi-square and verdict on each row."""
    amt = report_amount()
    digit = F.substring(F.format_string("%.0f", amt), 1, 1).cast("int")
    counts = bank.where(amt >= 10).select(digit.alias("digit")).where("digit between 1 and 9").groupBy("digit").agg(
        F.count(F.lit(1)).alias("k"))
    law = F.element_at(F.array(*map(F.lit, FIRST_DIGIT_PERCENT)), F.col("digit"))
    table = bank.sparkSession.range(1, 10).select(F.col("id").cast("int").alias("digit")).join(counts, "digit", "left")
    n = F.col("scalars")["n"]
    t = with_scalars(table, counts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))).select(
        "digit", F.coalesce("k", F.lit(0)).alias("observed"), law.alias("expected_pct"), n.alias("n"))
    want = F.col("expected_pct") / 100 * F.col("n")
    chi = t.agg(F.coalesce(F.sum(F.pow(F.col("observed") - want, 2) / (want + 1e-6)), F.lit(0.0)).alias("chi"))
    x = F.col("scalars")["chi"]
    return with_scalars(t, chi).select(
        "digit", "observed", F.when(F.col("n") > 0, F.round(F.col("observed") / F.col("n") * 100, 2)).otherwise(0.0)
        .alias("observed_pct"), "expected_pct", F.round(x, 2).alias("chi_square"),
        F.when(x > 15.5, "deviates").otherwise("conforms").alias("verdict"))


def amount_statistics(bank: DataFrame) -> DataFrame:
    """Mean, sample variance, eight interpolated percentiles and quartile fences of positive amounts."""
    rows = bank.select(report_amount().alias("amt")).where("amt > 0")
    q = {f"p{p}": p / 100 for p in (1, 10, 25, 50, 75, 90, 95, 99)}
    stats = linear_quantiles(rows, [], "amt", q)
    core = rows.agg(F.avg("amt").alias("mean"), F.coalesce(F.var_samp("amt"), F.lit(0.0)).alias("variance"),
                    F.min("amt").alias("smallest"), F.max("amt").alias("largest"))
    s, iqr = F.col("scalars"), F.col("p75") - F.col("p25")
    return with_scalars(stats, core).select(
        "n", *[s[c].alias(c) for c in ("mean", "variance", "smallest", "largest")], *q,
        (F.col("p25") - 1.5 * iqr).alias("lower_fence"), (F.col("p75") + 1.5 * iqr).alias("upper_fence"))


def top_parties(bank: DataFrame, top: int = 15) -> DataFrame:
    """Accounts by money out, accounts by money in, and paid-from parties of credit rows."""
    acc = bank.groupBy(F.coalesce("account_no", F.lit("?")).alias("party")).agg(
        F.count(F.lit(1)).alias("txns"), F.coalesce(F.sum("debit"), F.lit(0.0)).alias("out"),
        F.coalesce(F.sum("credit"), F.lit(0.0)).alias("inn"))
    ben = F.coalesce("receiver_account", "counterparty_name", "receiver_phone", "upi_id")
    named = bank.where(ben.isNotNull() & (F.coalesce("credit", F.lit(0.0)) != 0)).groupBy(ben.alias("party")).agg(
        F.count(F.lit(1)).alias("txns"), F.sum("credit").alias("amount"))

    def best(df, role, amount):
        return (df.select(F.lit(role).alias("role"), "party", "txns", F.col(amount).alias("amount")).where("amount > 0")
                .orderBy(F.desc("amount"), "party").limit(top))

    return best(acc, "sender", "out").unionByName(best(acc, "receiver", "inn")).unionByName(
        best(named, "beneficiary", "amount"))


def busy_slots(events: DataFrame, width: int = 1800, sigma: float = 2.5, floor: int = 15) -> DataFrame:
    """Tumbling slots whose event count exceeds mean + sigma deviations and a floor."""
    slots = events.where("ts is not null").groupBy(F.floor(F.col("ts") / width).cast("long").alias("slot")).agg(
        F.count(F.lit(1)).alias("n"))
    dev = F.stddev_pop("n")
    stats = slots.agg((F.avg("n") + sigma * F.when(dev == 0, 1.0).otherwise(dev)).alias("limit"))
    return (with_scalars(slots, stats).where((F.col("n") > F.col("scalars")["limit"]) & (F.col("n") >= floor))
            .select((F.col("slot") * width).alias("slot_ts"), "n"))


def kind_hours(events: DataFrame) -> DataFrame:
    return events.groupBy("kind", utc_hour(F.col("ts")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def dataset_counts(case: Case) -> DataFrame:
    """Rows, distinct identifiers and time coverage per dataset."""
    def one(df, name, key, ts):
        lo, hi = (F.min(ts), F.max(ts)) if ts else (F.lit(None).cast("long"), F.lit(None).cast("long"))
        return df.agg(F.count(F.lit(1)).alias("records"), F.count_distinct(key).alias("identifiers"), lo.alias("first_ts"),
                      hi.alias("last_ts")).select(F.lit(name).alias("dataset"), "*")

    return (one(case.bank, "bank", "account_no", "ts").unionByName(one(case.cdr, "cdr", "a_number", "ts"))
            .unionByName(one(case.ipdr, "ipdr", "msisdn", "start_ts"))
            .unionByName(one(case.complaints, "complaints", "account_no", None))
            .unionByName(one(case.subscribers, "subscribers", "msisdn", None)))


def account_totals(bank: DataFrame) -> DataFrame:
    return bank.where("account_no is not null").groupBy("account_no").agg(
        F.coalesce(F.sum("debit"), F.lit(0.0)).alias("debit"), F.coalesce(F.sum("credit"), F.lit(0.0)).alias("credit"),
        F.count(F.lit(1)).alias("txns"))
