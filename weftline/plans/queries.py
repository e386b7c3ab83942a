"""Parameterised investigator queries over the two-leg view and the link tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.case import Case
from weftline.operators.links import bank_call_links


def by_id(rows: DataFrame, id_column: str, value: str) -> DataFrame:
    return rows.where(F.lower(id_column) == value.lower())


def account_history(legs: DataFrame, value: str, limit: int = 30) -> DataFrame:
    hit = (F.col("sender_account") == value) | (F.col("receiver_account") == value) | (F.col("sender_customer_id") == value)
    return legs.where(hit).orderBy("timestamp", "txn_id").limit(limit)


def account_like(legs: DataFrame, part: str, limit: int = 30) -> DataFrame:
    hit = F.contains("sender_account", F.lit(part)) | F.contains("receiver_account", F.lit(part))
    return legs.where(hit).orderBy("timestamp", "txn_id").limit(limit)


def traced_payments(legs: DataFrame, reach: DataFrame) -> DataFrame:
    """Direct payments of each traced account, in time order, with the reach of its trace.

    ``reach`` is (seed, nodes, farthest_hop); a seed without payments has one row without a payment.
    """
    ends = legs.select("txn_id", "timestamp", "amount", "sender_account", "receiver_account", "mode", F.explode(F.array_distinct(F.array("sender_account", "receiver_account"))).alias("seed"))
    return reach.join(ends, "seed", "left").orderBy("seed", "timestamp", "txn_id")


def shared_hardware(ipdr: DataFrame, limit: int = 25, shown: int = 10) -> DataFrame:
    """Devices by number of phones; the phone list is cut by name before it is collected."""
    from weftline.operators.aggregates import shared_by
    return shared_by(ipdr, "imei", "msisdn", 1, limit, shown)


def nearest_calls(case: Case, legs: DataFrame, limit: int = 20) -> DataFrame:
    return (bank_call_links(case, pay=legs, call=case.cdr.select("cdr_id", "a_number", "b_number"))
            .orderBy("time_diff", F.desc("amount"), "txn_id", "cdr_id").limit(limit))


def _first_names(rows: DataFrame, key: str, value: str, shown: int) -> DataFrame:
    from pyspark.sql import Window as W
    w = W.partitionBy(key).orderBy(value)
    d = rows.where(F.col(value).isNotNull()).select(key, value).distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= shown)
    return d.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(value + "s"))


def dispersal(legs: DataFrame, limit: int = 15, shown: int = 20) -> DataFrame:
    """Senders with more than one transfer."""
    g = legs.where("sender_account is not null").groupBy("sender_account").agg(
        F.count(F.lit(1)).alias("transfers"), F.sum("amount").alias("volume"), F.min("timestamp").alias("first_tx"), F.max("timestamp").alias("last_tx"),
    ).where("transfers > 1").orderBy(F.desc("transfers"), F.desc("volume"), "sender_account").limit(limit)
    return g.join(_first_names(legs, "sender_account", "receiver_account", shown), "sender_account", "left")


def collectors(legs: DataFrame, limit: int = 15) -> DataFrame:
    """Receivers by number and volume of incoming transfers."""
    return legs.where("receiver_account is not null").groupBy("receiver_account").agg(
        F.count(F.lit(1)).alias("incoming"), F.sum("amount").alias("volume"), F.array_join(F.sort_array(F.collect_set("mode")), ",").alias("channels")
    ).orderBy(F.desc("incoming"), F.desc("volume"), "receiver_account").limit(limit)


def complaint_first(legs: DataFrame, complaints: DataFrame, limit: int = 15) -> DataFrame:
    c = complaints.groupBy("account_no").agg(F.min("state").alias("state"))
    s = legs.join(c.toDF("sender_account", "ss"), "sender_account", "left").join(c.toDF("receiver_account", "rs"), "receiver_account", "left")
    s = s.withColumn("state", F.coalesce("rs", "ss")).withColumn("flag", F.when(F.col("state").isNotNull(), 1).otherwise(0))
    return s.orderBy(F.desc("flag"), F.desc("amount"), "txn_id").limit(limit)


def largest(legs: DataFrame, limit: int = 20) -> DataFrame:
    return legs.orderBy(F.desc("amount"), "txn_id").limit(limit)


def near_tower(case: Case, legs: DataFrame, places: list[str], window: int = 300, limit: int = 20) -> DataFrame:
    """Payments close to calls from towers or circles whose name contains one of ``places``."""
    text = F.lower(F.concat_ws(" ", "bts_location_first", "roaming_circle"))
    at = F.exists(F.array(*[F.lit(p.lower()) for p in places]), lambda p: F.contains(text, p))
    calls = case.cdr.where(at).select("cdr_id", "a_number", "roaming_circle")
    return (bank_call_links(case, window, pay=legs, call=calls)
            .orderBy(F.desc("amount"), "txn_id", "cdr_id").limit(limit))


def phone_records(legs: DataFrame, cdr: DataFrame, ipdr: DataFrame, phone: str, limit: int = 30) -> DataFrame:
    """Everything touching a phone, as a union of keyed projections."""
    p = F.lit(phone)
    pay = legs.where((F.col("sender_phone") == p) | (F.col("receiver_phone") == p)).select(
        F.lit("payment").alias("kind"), F.col("txn_id").alias("id"), "ts")
    call = cdr.where((F.col("a_number") == p) | (F.col("b_number") == p)).select(F.lit("call").alias("kind"), F.col("cdr_id").alias("id"), "ts")
    sess = ipdr.where(F.col("msisdn") == p).select(F.lit("session").alias("kind"), F.col("ipdr_id").alias("id"), F.col("start_ts").alias("ts"))
    return pay.unionByName(call).unionByName(sess).orderBy("ts", "kind", "id").limit(limit)


def by_amount_and_mode(legs: DataFrame, at_least: float, mode: str) -> DataFrame:
    return legs.where((F.col("amount") >= at_least) & (F.upper("mode") == mode.upper()))


def top_receivers(legs: DataFrame, limit: int = 15) -> DataFrame:
    a = legs.where("receiver_account is not null").groupBy("receiver_account").agg(
        F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n"), F.count_distinct("sender_account").alias("senders"), F.max("amount").alias("max_leg"))
    return a.orderBy(F.desc("total"), "receiver_account").limit(limit)


def high_value_with_calls(case: Case, legs: DataFrame, limit: int = 20) -> DataFrame:
    """The largest payments with their calls. Each payment gives a row at least, so only the first ``limit`` are linked."""
    first = legs.orderBy(F.desc("amount"), "txn_id").limit(limit).select("txn_id").distinct()
    legs = legs.join(F.broadcast(first), "txn_id", "left_semi")
    bank_links = bank_call_links(replace(case, bank=case.bank.join(F.broadcast(first), "txn_id", "left_semi")))
    return (legs.join(bank_links, "txn_id", "left").orderBy(F.desc("amount"), "txn_id", F.asc_nulls_first("time_diff"), "cdr_id").limit(limit))


def turnover(legs: DataFrame, limit: int = 10) -> DataFrame:
    ends = legs.select("amount", F.explode(F.array_compact(F.array("sender_account", "receiver_account"))).alias("account"))
    return ends.groupBy("account").agg(F.sum("amount").alias("turnover"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("turnover"), "account").limit(limit)


def longest_calls(cdr: DataFrame, limit: int = 10) -> DataFrame:
    return cdr.orderBy(F.desc("duration_sec"), "cdr_id").limit(limit)


def text_search(legs: DataFrame, q: str, limit: int = 30) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "txn_id", "narration", "sender_name", "receiver_name", "sender_account", "receiver_account"))
    return legs.where(F.contains(hay, F.lit(q.lower()))).orderBy("txn_id").limit(limit)


def table_counts(**tables: DataFrame) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("dataset"), "records", F.lit(len(df.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- search and retrieval

def search(case, registry: DataFrame, q: str, limit: int = 50) -> DataFrame:
    """Identifiers, complaints and payments containing the text, in kind order."""
    q = q.strip().lower()
    order = {"account": 1, "phone": 2, "upi": 3, "imei": 4, "imsi": 5, "ip": 6}
    rank = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    ids = registry.where(F.col("kind").isin(*order) & F.contains(F.lower("value"), F.lit(q))).select(
        F.try_element_at(rank, F.col("kind")).alias("o"), "kind", F.col("value").alias("key"))
    com = F.lower(F.concat_ws(" ", "account_no", "mobile", "state", "bank_name"))
    complaints = case.complaints.where(F.contains(com, F.lit(q))).select(F.lit(7).alias("o"), F.lit("complaint").alias("kind"),
                                                                         F.coalesce("account_no", "complaint_id").alias("key"))
    hay = F.lower(F.concat_ws(" ", "txn_id", "narration", "counterparty_name", "receiver_account", "upi_id", "receiver_phone", "sender_phone", "account_name"))
    pay = case.bank.where(F.contains(hay, F.lit(q))).select(F.lit(8).alias("o"), F.lit("transaction").alias("kind"), F.col("txn_id").alias("key"))
    return ids.unionByName(complaints).unionByName(pay).orderBy("o", "key").limit(limit)


def retrieve(requests: DataFrame, case, legs: DataFrame, per_table: int = 3, top_k: int = 8) -> DataFrame:
    """Evidence rows for free-text requests (request_id, text): up to three rows per identifier and table."""
    from functools import reduce

    from pyspark.sql import Window as W

    from weftline.functions.hints import hints
    h = hints(F.col("text"))
    keys = ("phone", "txn", "cdr", "ipdr", "account", "imei", "ip")
    named = requests.select("request_id", F.explode(F.concat(*[_tag(h[k], k) for k in keys])).alias("x")).select("request_id", "x.*").distinct()

    def side(df, table, rid, kind, *cols, short=False):
        value = F.explode(F.array_distinct(F.array_compact(F.array(*[F.right(c, F.lit(10)) if short else F.col(c) for c in cols]))))
        return df.select(F.lit(table).alias("table"), F.col(rid).alias("id"), F.lit(kind).alias("kind"), value.alias("value"))

    sides = [side(legs, "bank", "txn_id", "phone", "sender_phone", "receiver_phone", short=True), side(legs, "bank", "txn_id", "txn", "txn_id"),
             side(legs, "bank", "txn_id", "account", "sender_account", "receiver_account"),
             side(case.cdr, "cdr", "cdr_id", "phone", "a_number", "b_number", short=True), side(case.cdr, "cdr", "cdr_id", "cdr", "cdr_id"),
             side(case.cdr, "cdr", "cdr_id", "imei", "imei"),
             side(case.ipdr, "ipdr", "ipdr_id", "phone", "msisdn", short=True), side(case.ipdr, "ipdr", "ipdr_id", "ipdr", "ipdr_id"),
             side(case.ipdr, "ipdr", "ipdr_id", "imei", "imei"), side(case.ipdr, "ipdr", "ipdr_id", "ip", "source_ip", "dest_ip")]
    # only identifiers somebody asked for; the first rows of each are ranked before they meet the requests
    asked = named.select("kind", "value").distinct()
    w = W.partitionBy("kind", "value", "table").orderBy("id")
    rows = reduce(DataFrame.unionByName, sides).join(asked, ["kind", "value"]).withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_table)
    hits = named.join(rows, ["kind", "value"]).groupBy("request_id", "table", "id").agg(F.min("kind").alias("kind"))
    top = W.partitionBy("request_id").orderBy("table", "id")
    return hits.withColumn("pos", F.row_number().over(top)).where(F.col("pos") <= top_k)


def _tag(values, kind: str):
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
