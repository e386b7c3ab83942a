"""Identifiers of the records, acknowledgement numbers and shortened numbers, each with the type the records confirm."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, entry
from weftline.operators.aggregates import entity_registry
from weftline.operators.identity import confirmed_types


@entry("x19_confirmed_types", """
WITH v AS (SELECT value, CASE kind WHEN 'imsi' THEN 'account' ELSE kind END AS form FROM registry WHERE kind IN ('phone', 'account', 'imei', 'imsi', 'ip')
  UNION SELECT ack_no, CASE WHEN length(ack_no) >= 7 THEN 'account' ELSE 'identifier' END FROM f_complaint UNION SELECT right(msisdn, 5), 'account' FROM f_sub UNION SELECT 'L' || right(msisdn, 6), 'account' FROM f_sub)
SELECT value, form, CASE WHEN form IN ('phone', 'ip', 'imei') THEN form WHEN value IN (SELECT ack_no FROM f_complaint) THEN 'complaint'
  WHEN value IN (SELECT account_no FROM f_bank) OR value IN (SELECT receiver_account FROM f_bank) THEN 'account'
  WHEN length(value) = 5 AND value IN (SELECT right(msisdn, 5) FROM f_sub) OR right(value, 10) IN (SELECT right(msisdn, 10) FROM f_sub) THEN 'phone' ELSE form END AS type FROM v""")
def x19_confirmed(t: Tables):
    known = entity_registry(t.case).where(F.col("kind").isin("phone", "account", "imei", "imsi", "ip")).select("value")
    rows = known.unionByName(t.complaints.select(F.col("ack_no").alias("value"))).unionByName(t.subscribers.select(F.right("msisdn", F.lit(5)).alias("value"))).unionByName(
        t.subscribers.select(F.concat(F.lit("L"), F.right("msisdn", F.lit(6))).alias("value")))
    return confirmed_types(rows, t.case)
