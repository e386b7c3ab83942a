"""Two-leg and side views over the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.ids import phone_lenient


def bank_legs(bank: DataFrame) -> DataFrame:
    """Payments with explicit sender and receiver; a credit row's own account is the receiver."""
    credit = F.upper(F.coalesce("txn_type", F.lit("D"))) == "C"
    stamp = F.trim(F.concat_ws(" ", "date", "time"))
    amount = F.coalesce(*[F.when(F.col(c) != 0, F.col(c)) for c in ("amount", "debit", "credit") if c in bank.columns],
                        F.lit(0.0))
    return bank.select(
        "txn_id", "date", stamp.alias("timestamp"), "narration", "mode", F.lit("INR").alias("currency"),
        amount.alias("amount"), F.col("customer_id").alias("sender_customer_id"),
        F.col("account_name").alias("sender_name"), F.col("bank").alias("sender_bank"),
        F.when(credit, F.col("receiver_account")).otherwise(F.col("account_no")).alias("sender_account"),
        F.when(credit, F.col("account_no")).otherwise(F.col("receiver_account")).alias("receiver_account"),
        phone_lenient(F.col("sender_phone")).alias("sender_phone"),
        phone_lenient(F.col("receiver_phone")).alias("receiver_phone"),
        F.col("counterparty_name").alias("receiver_name"), F.col("counterparty_bank").alias("receiver_bank"), "ts")


def call_view(cdr: DataFrame) -> DataFrame:
    return cdr.select("cdr_id", "date", "time", F.col("a_number").alias("a_party"), F.col("b_number").alias("b_party"),
                      "call_type", F.coalesce("duration_sec", F.lit(0)).alias("duration_sec"), "imsi", "imei",
                      F.col("bts_location_first").alias("bts_location"), F.col("cell_id_first").alias("cell_id"),
                      "roaming_circle", "ts")


def session_view(ipdr: DataFrame) -> DataFrame:
    return ipdr.select("ipdr_id", "date", "start_time", "imsi", "msisdn", "imei", "source_ip", "dest_ip", "cell_id",
                       F.coalesce("duration_sec", F.lit(0)).alias("duration_sec"), "start_ts")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``. ``min_by`` combines map-side, so a key with very many
    copies never becomes one large sort."""
    cols = df.columns
    row = F.min_by(F.struct(*cols), F.struct(*order))
    return df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(row.alias("r")).select("r.*").select(*cols)


def _filled(df: DataFrame, columns: tuple[str, ...]) -> list:
    from weftline.functions.ids import blank_to_null
    return [(blank_to_null(F.col(c).cast("string")) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns]


def _whole(df: DataFrame, name: str):
    c = F.col(name).try_cast("long") if name in df.columns else F.lit(None).cast("long")
    return F.coalesce(c, F.lit(0).cast("long")).alias(name)


def canonical_calls(raw: DataFrame) -> DataFrame:
    """Call rows with clean numbers, devices and epoch."""
    from weftline.functions import clock, ids
    ts = clock.to_epoch(F.col("date"), F.col("time"))
    return raw.select("cdr_id", ids.phone(F.col("a_number")).alias("a_number"), ids.phone(F.col("b_number")).alias("b_number"), "call_type", "date", "time",
                      _whole(raw, "duration_sec"), ids.device(F.col("imei")).alias("imei"), ids.device(F.col("imsi")).alias("imsi"),
                      *_filled(raw, ("operator", "service_type", "cell_id_first", "cell_id_last", "bts_location_first", "bts_location_last", "roaming_circle")),
                      (F.coalesce(F.col("ts").cast("long"), ts) if "ts" in raw.columns else ts).alias("ts"))


def canonical_sessions(raw: DataFrame) -> DataFrame:
    """Session rows with clean number, devices, addresses and epochs."""
    from weftline.functions import clock, ids
    start = clock.to_epoch(F.col("date"), F.col("start_time"))
    return raw.select("ipdr_id", ids.phone(F.col("msisdn")).alias("msisdn"), ids.device(F.col("imsi")).alias("imsi"), ids.device(F.col("imei")).alias("imei"),
                      ids.ip(F.col("source_ip")).alias("source_ip"), ids.ip(F.col("dest_ip")).alias("dest_ip"), "date", "start_time", start.alias("start_ts"),
                      _whole(raw, "duration_sec"), _whole(raw, "volume_up"), _whole(raw, "volume_down"), *_filled(raw, ("cell_id", "roaming_circle", "operator")))


def canonical_complaints(raw: DataFrame) -> DataFrame:
    from weftline.functions import ids
    return raw.select("complaint_id", F.nullif(ids.digits(F.col("account_no")), F.lit("")).alias("account_no"), ids.phone(F.col("mobile")).alias("mobile"),
                      *_filled(raw, ("ack_no", "bank_name", "state", "district", "police_station", "officer_name", "designation", "email")))


def canonical_subscribers(raw: DataFrame) -> DataFrame:
    from weftline.functions import ids
    return raw.select("sub_id", ids.phone(F.col("msisdn")).alias("msisdn"), ids.device(F.col("imsi")).alias("imsi"), ids.device(F.col("imei")).alias("imei"),
                      *_filled(raw, ("subscriber_name", "father_name", "address", "circle", "connection_type", "activation_date", "email")))
