"""Canonical views over the supplied test tables.

``events`` becomes payments, calls and data sessions; ``customer`` becomes complaints and
subscribers; ``lineitem`` joined to ``orders`` becomes a date-only ledger. All of them are plain
projections, so column pruning and filters reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.case import Case
from weftline.functions.clock import iso_date, hhmmss

ANCHOR = 1704067200
COMPRESSION = 24


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _epoch(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session zone."""
    days = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "events")
    sec = _epoch(F.col("ts"))
    return raw.select(
        "event_id", "user_id", "event_type", "value",
        F.regexp_extract("props", r'"k": *(\d+)', 1).cast("long").alias("k"),
        (F.lit(ANCHOR) + F.floor((sec - ANCHOR) / COMPRESSION)).cast("long").alias("ts"),
    )


def _account(n: Column) -> Column:
    return F.concat(F.lit("1000"), F.lpad(n.cast("string"), 6, "0"))


def _phone(n: Column) -> Column:
    return F.concat(F.lit("91"), (F.lit(9000000000) + n).cast("string"))


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where(F.col("event_type").isin("purchase", "error"))
    eid, user, k, ts = F.col("event_id"), F.col("user_id"), F.col("k"), F.col("ts")
    amount = F.floor(F.col("value") * 10).cast("double") * 500
    is_debit = eid % 3 != 0
    kind = eid % 5
    ref = F.lpad(eid.cast("string"), 12, "0")
    mode = F.element_at(F.array(*map(F.lit, ("UPI", "IMPS", "NEFT", "ATM", "POS"))), (kind + 1).cast("int"))
    banks = F.array(*map(F.lit, ("Axis Bank", "HDFC Bank", "ICICI Bank", "State Bank of India")))
    ks = k.cast("string")
    narration = (
        F.when(kind == 0, F.concat(F.lit("UPI/P2A/"), ref, F.lit("/PAYEE "), ks, F.lit("/user"), ks, F.lit("@okaxis")))
        .when(kind == 1, F.concat(F.lit("IMPS/"), _account(k), F.lit(" RRN: "), ref, F.lit(" HDFC BANK")))
        .when(kind == 2, F.concat(F.lit("NEFT/"), _account(k), F.lit(" UTR: "), ref, F.lit(" SALARY")))
        .when(kind == 3, F.concat(F.lit("ATM CASH WITHDRAWAL "), ks))
        .otherwise(F.concat(F.lit("POS SWIPE AMAZON "), ks))
    )
    return e.select(
        F.concat(F.lit("T"), eid.cast("string")).alias("txn_id"),
        F.element_at(banks, (user % 4 + 1).cast("int")).alias("bank"),
        _account(user).alias("account_no"),
        F.concat(F.lit("HOLDER "), user.cast("string")).alias("account_name"),
        _account(user).alias("customer_id"),
        _account(k).alias("receiver_account"),
        amount.alias("amount"),
        F.when(is_debit, amount).alias("debit"),
        F.when(~is_debit, amount).alias("credit"),
        F.floor(F.col("value") * 100).cast("double").alias("balance"),
        F.when(is_debit, F.lit("D")).otherwise(F.lit("C")).alias("txn_type"),
        _phone(user).alias("sender_phone"),
        _phone(k).alias("receiver_phone"),
        mode.alias("mode"),
        narration.alias("narration"),
        F.when(kind == 0, F.concat(F.lit("user"), ks, F.lit("@okaxis"))).alias("upi_id"),
        F.when(kind == 0, F.concat(F.lit("PAYEE "), ks)).alias("counterparty_name"),
        F.when(k % 5 < 4, F.element_at(banks, F.least(k % 5 + 1, F.lit(4)).cast("int"))).alias("counterparty_bank"),
        F.when(kind == 4, F.lit("AMAZON")).alias("merchant_name"),
        F.when(kind == 3, F.lit("ATM/CASH")).when(kind == 0, F.lit("UPI")).alias("payment_gateway"),
        ts.alias("ts"), iso_date(ts).alias("date"), hhmmss(ts).alias("time"),
    )


def cdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    eid, user, k, ts = F.col("event_id"), F.col("user_id"), F.col("k"), F.col("ts")
    kinds = F.array(*map(F.lit, ("IN", "OUT", "SMS", "VOICE")))
    circles = F.array(*map(F.lit, ("Delhi", "Mumbai", "Karnataka", "Punjab", "Kerala")))
    return e.select(
        F.concat(F.lit("C"), eid.cast("string")).alias("cdr_id"),
        F.lit("TELCO").alias("operator"),
        _phone(user).alias("a_number"), _phone(k).alias("b_number"),
        F.element_at(kinds, (eid % 4 + 1).cast("int")).alias("call_type"),
        F.lit("GSM").alias("service_type"),
        F.floor(F.col("value")).cast("long").alias("duration_sec"),
        _imei(user, eid).alias("imei"),
        (F.lit(404000000000000) + user).cast("string").alias("imsi"),
        F.concat(F.lit("CELL"), (k % 20).cast("string")).alias("cell_id_first"),
        F.lit(None).cast("string").alias("cell_id_last"),
        F.lit(None).cast("string").alias("bts_location_first"),
        F.element_at(circles, (k % 5 + 1).cast("int")).alias("roaming_circle"),
        ts.alias("ts"), iso_date(ts).alias("date"), hhmmss(ts).alias("time"),
    )


def _imei(user: Column, eid: Column) -> Column:
    n = F.lit(350000000000000) + F.floor(user / 2) * 3 + F.when(eid % 7 == 0, 1).otherwise(0)
    return n.cast("string")


def ipdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where(F.col("event_type") == "signup")
    eid, user, k, ts = F.col("event_id"), F.col("user_id"), F.col("k"), F.col("ts")
    dur = F.floor(F.col("value")).cast("long")
    circles = F.array(*map(F.lit, ("Delhi", "Mumbai", "Karnataka", "Punjab", "Kerala")))
    return e.select(
        F.concat(F.lit("I"), eid.cast("string")).alias("ipdr_id"),
        F.lit("TELCO").alias("operator"),
        _phone(user).alias("msisdn"),
        (F.lit(404000000000000) + user).cast("string").alias("imsi"),
        _imei(user, eid).alias("imei"),
        F.concat(F.lit("10.0."), (k % 10).cast("string"), F.lit("."), (user % 5).cast("string")).alias("source_ip"),
        F.concat(F.lit("203.0.113."), k.cast("string")).alias("dest_ip"),
        F.concat(F.lit("CELL"), (k % 20).cast("string")).alias("cell_id"),
        ts.alias("start_ts"), (ts + dur).alias("end_ts"), dur.alias("duration_sec"),
        (dur * 1000).alias("volume_up"), (dur * 5000).alias("volume_down"),
        F.element_at(circles, (k % 5 + 1).cast("int")).alias("roaming_circle"),
        iso_date(ts).alias("date"), hhmmss(ts).alias("start_time"),
    )


def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0)
    n = read(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.concat(F.lit("cmp_"), F.col("c_custkey").cast("string")).alias("complaint_id"),
        _account(F.col("c_custkey")).alias("account_no"),
        F.col("n_name").alias("state"),
        F.lit("Axis Bank").alias("bank_name"),
        F.concat(F.lit("ACK"), F.col("c_custkey").cast("string")).alias("ack_no"),
        _phone(F.col("c_custkey")).alias("mobile"),
    )


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("sub_"), key.cast("string")).alias("sub_id"),
        _phone(key).alias("msisdn"),
        (F.lit(404000000000000) + key).cast("string").alias("imsi"),
        (F.lit(350000000000000) + F.floor(key / 2) * 3).cast("long").cast("string").alias("imei"),
        F.col("c_name").alias("subscriber_name"),
        F.col("c_mktsegment").alias("circle"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date-only ledger; the order side joins on its key, sized by the optimizer at run time."""
    li = read(spark, sf_dir, "lineitem")
    o = read(spark, sf_dir, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    price = F.col("l_extendedprice")
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return j.select(
        F.concat_ws("-", F.concat(F.lit("L"), F.col("l_orderkey")), "l_linenumber", "l_partkey", "l_suppkey",
                    F.round(price * 100).cast("long")).alias("txn_id"),
        F.concat(F.lit("C"), F.col("o_custkey")).alias("account_no"),
        F.concat(F.lit("C"), F.col("o_custkey")).alias("customer_id"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("receiver_account"),
        price.alias("amount"), price.alias("debit"), F.lit(None).cast("double").alias("credit"),
        F.lit("D").alias("txn_type"),
        (day * 86400).alias("ts"), iso_date(day * 86400).alias("date"),
        F.lit(None).cast("string").alias("time"),
        F.col("l_returnflag").alias("mode"),
        F.lit(None).cast("string").alias("sender_phone"),
        F.lit(None).cast("string").alias("receiver_phone"),
    )


def case(spark: SparkSession, sf_dir: str) -> Case:
    return Case(
        bank=bank(spark, sf_dir), cdr=cdr(spark, sf_dir), ipdr=ipdr(spark, sf_dir),
        complaints=complaints(spark, sf_dir), subscribers=subscribers(spark, sf_dir),
    )
