"""Identifier texts with the type that the records confirm."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.case import Case
from weftline.functions.hints import identifier_type

#: Types that the form alone settles.
CERTAIN = ("phone", "ip", "imei", "transaction", "ifsc")
#: What the records may confirm, the first that fits winning.
CONFIRMED = ("complaint", "account", "phone")
#: A text is a subscriber's when the number ends with its last characters, at most this many.
TAIL = 10


def identifier_dictionary(case: Case) -> DataFrame:
    """(match, text, place): acknowledgement numbers and accounts as whole texts, subscriber numbers by each of their endings."""
    def texts(df: DataFrame, column: str, place: int) -> DataFrame:
        return df.select(F.lit("whole").alias("match"), F.col(column).cast("string").alias("text"), F.lit(place).alias("place"))

    number = F.col("msisdn").cast("string")
    ends = case.subscribers.select(F.lit("end").alias("match"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(TAIL)), lambda k: F.right(number, k))).alias("text"), F.lit(2).alias("place"))
    parts = [texts(case.complaints, "ack_no", 0), texts(case.bank, "account_no", 1), texts(case.bank, "receiver_account", 1), ends]
    return reduce(DataFrame.unionByName, parts).where("text is not null and text <> ''").groupBy("match", "text").agg(F.min("place").alias("place"))


def confirmed_types(values: DataFrame, case: Case, column: str = "value") -> DataFrame:
    """(value, form, type) of every distinct text: the type by its form, and the type that complaints, ledgers or subscribers confirm.

    Forms that leave doubt are looked up by equality in one dictionary; the planner's runtime Bloom filter keeps most of a large
    dictionary out of the shuffle. Null and blank texts keep the type of their form.
    """
    asked = values.select(F.col(column).cast("string").alias("value")).distinct().withColumn("form", identifier_type(F.col("value")))
    text = F.trim("value")
    keys = F.array(F.struct(F.lit("whole").alias("match"), text.alias("text")), F.struct(F.lit("end").alias("match"), F.right(text, F.lit(TAIL)).alias("text")))
    open_ = asked.where(~F.col("form").isin(*CERTAIN) & (text != "")).select("value", F.explode(keys).alias("k")).select("value", "k.match", "k.text")
    found = open_.join(identifier_dictionary(case), ["match", "text"]).groupBy("value").agg(F.min("place").alias("place"))
    name = F.coalesce(*[F.when(F.col("place") == n, kind) for n, kind in enumerate(CONFIRMED)])
    return asked.join(found, "value", "left").select("value", "form", F.coalesce(name, "form").alias("type"))
