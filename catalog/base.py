"""Registration of queries and assembly of the DuckDB text that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import standins
from weftline.case import Case
from weftline.session import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
VIEWS: dict[str, str] = {}


class Tables:
    """Lazily built views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._kept = spark, sf_dir, False

    def read(self, table: str) -> DataFrame:
        return standins.read(self.spark, self.sf_dir, table)

    @cached_property
    def bank(self) -> DataFrame:
        return standins.bank(self.spark, self.sf_dir)

    @cached_property
    def cdr(self) -> DataFrame:
        return standins.cdr(self.spark, self.sf_dir)

    @cached_property
    def ipdr(self) -> DataFrame:
        return standins.ipdr(self.spark, self.sf_dir)

    @cached_property
    def complaints(self) -> DataFrame:
        return standins.complaints(self.spark, self.sf_dir)

    @cached_property
    def subscribers(self) -> DataFrame:
        return standins.subscribers(self.spark, self.sf_dir)

    @cached_property
    def ledger(self) -> DataFrame:
        return standins.ledger(self.spark, self.sf_dir)

    @cached_property
    def case(self) -> Case:
        return Case(self.bank, self.cdr, self.ipdr, self.complaints, self.subscribers)

    def keep(self) -> None:
        """Write payments, calls and sessions once, for jobs that read them dozens of times; what is asked for later reads them there."""
        if not self._kept:
            self.bank, self.cdr, self.ipdr, self._kept = kept(self.bank), kept(self.cdr), kept(self.ipdr), True
            self.__dict__.pop("case", None)


def entry(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def view(name: str, sql: str) -> None:
    """Named SQL fragment usable by any check."""
    assert name not in VIEWS, name
    VIEWS[name] = sql


def _mentions(text: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text))
    return [name for name in VIEWS if name in words]


def oracle(sql: str) -> str:
    """Prefix the fragments a check mentions, each after those it builds on."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name not in needed:
            for other in _mentions(VIEWS[name]):
                if other != name:
                    visit(other)
            needed.append(name)

    for name in _mentions(sql):
        visit(name)
    if not needed:
        return sql
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    body = sql[own.end():] if own else sql
    recursive = (own and own.group(1)) or any(n in _mentions(VIEWS[n]) for n in needed)
    return (("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
            + (",\n" if own else "\n") + body)


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Doubles rounded on this side too, so that summation order cannot show."""
    return df.select(*[F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`")
                       for n, t in df.dtypes])


# ---------------------------------------------------------------- stand-in views

view("ev", """
  SELECT event_id, user_id, event_type, value,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k,
         CAST(1704067200 + floor((floor(epoch(ts)) - 1704067200) / 24) AS BIGINT) AS ts
  FROM events""")

_DATE = "strftime(make_timestamp(ts * 1000000), '%Y-%m-%d')"
_TIME = "strftime(make_timestamp(ts * 1000000), '%H:%M:%S')"
_IMEI = "CAST(350000000000000 + (user_id // 2) * 3 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR)"
_BANKS = "['Axis Bank','HDFC Bank','ICICI Bank','State Bank of India']"
_CIRCLES = "['Delhi','Mumbai','Karnataka','Punjab','Kerala']"

view("f_bank", f"""
  SELECT 'T' || event_id AS txn_id, {_BANKS}[user_id % 4 + 1] AS bank,
    '1000' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS account_no, 'HOLDER ' || user_id AS account_name,
    '1000' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS customer_id,
    '1000' || lpad(CAST(k AS VARCHAR), 6, '0') AS receiver_account,
    floor(value * 10) * 500 AS amount,
    CASE WHEN event_id % 3 <> 0 THEN floor(value * 10) * 500 END AS debit,
    CASE WHEN event_id % 3 = 0 THEN floor(value * 10) * 500 END AS credit,
    floor(value * 100) AS balance,
    CASE WHEN event_id % 3 <> 0 THEN 'D' ELSE 'C' END AS txn_type,
    '91' || (9000000000 + user_id) AS sender_phone, '91' || (9000000000 + k) AS receiver_phone,
    ['UPI','IMPS','NEFT','ATM','POS'][event_id % 5 + 1] AS mode,
    CASE event_id % 5
      WHEN 0 THEN 'UPI/P2A/' || lpad(CAST(event_id AS VARCHAR), 12, '0') || '/PAYEE ' || k || '/user' || k || '@okaxis'
      WHEN 1 THEN 'IMPS/1000' || lpad(CAST(k AS VARCHAR), 6, '0') || ' RRN: ' || lpad(CAST(event_id AS VARCHAR), 12, '0') || ' HDFC BANK'
      WHEN 2 THEN 'NEFT/1000' || lpad(CAST(k AS VARCHAR), 6, '0') || ' UTR: ' || lpad(CAST(event_id AS VARCHAR), 12, '0') || ' SALARY'
      WHEN 3 THEN 'ATM CASH WITHDRAWAL ' || k
      ELSE 'POS SWIPE AMAZON ' || k END AS narration,
    CASE WHEN event_id % 5 = 0 THEN 'user' || k || '@okaxis' END AS upi_id,
    CASE WHEN event_id % 5 = 0 THEN 'PAYEE ' || k END AS counterparty_name,
    CASE WHEN k % 5 < 4 THEN {_BANKS}[k % 5 + 1] END AS counterparty_bank,
    CASE WHEN event_id % 5 = 4 THEN 'AMAZON' END AS merchant_name,
    CASE event_id % 5 WHEN 3 THEN 'ATM/CASH' WHEN 0 THEN 'UPI' END AS payment_gateway,
    ts, {_DATE} AS date, {_TIME} AS time
  FROM ev WHERE event_type IN ('purchase', 'error')""")

view("f_cdr", f"""
  SELECT 'C' || event_id AS cdr_id, 'TELCO' AS operator,
    '91' || (9000000000 + user_id) AS a_number, '91' || (9000000000 + k) AS b_number,
    ['IN','OUT','SMS','VOICE'][event_id % 4 + 1] AS call_type, 'GSM' AS service_type,
    CAST(floor(value) AS BIGINT) AS duration_sec, {_IMEI} AS imei,
    CAST(404000000000000 + user_id AS VARCHAR) AS imsi, 'CELL' || (k % 20) AS cell_id_first,
    CAST(NULL AS VARCHAR) AS cell_id_last, CAST(NULL AS VARCHAR) AS bts_location_first,
    {_CIRCLES}[k % 5 + 1] AS roaming_circle, ts, {_DATE} AS date, {_TIME} AS time
  FROM ev WHERE event_type IN ('view', 'click')""")

view("f_ipdr", f"""
  SELECT 'I' || event_id AS ipdr_id, 'TELCO' AS operator, '91' || (9000000000 + user_id) AS msisdn,
    CAST(404000000000000 + user_id AS VARCHAR) AS imsi, {_IMEI} AS imei,
    '10.0.' || (k % 10) || '.' || (user_id % 5) AS source_ip, '203.0.113.' || k AS dest_ip,
    'CELL' || (k % 20) AS cell_id, ts AS start_ts, ts + CAST(floor(value) AS BIGINT) AS end_ts,
    CAST(floor(value) AS BIGINT) AS duration_sec, CAST(floor(value) AS BIGINT) * 1000 AS volume_up,
    CAST(floor(value) AS BIGINT) * 5000 AS volume_down, {_CIRCLES}[k % 5 + 1] AS roaming_circle,
    {_DATE} AS date, {_TIME} AS start_time
  FROM ev WHERE event_type = 'signup'""")

view("f_complaint", """
  SELECT 'cmp_' || c_custkey AS complaint_id, '1000' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS account_no,
    n_name AS state, 'Axis Bank' AS bank_name, 'ACK' || c_custkey AS ack_no, '91' || (9000000000 + c_custkey) AS mobile
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0""")

view("f_sub", """
  SELECT 'sub_' || c_custkey AS sub_id, '91' || (9000000000 + c_custkey) AS msisdn,
    CAST(404000000000000 + c_custkey AS VARCHAR) AS imsi,
    CAST(350000000000000 + (c_custkey // 2) * 3 AS VARCHAR) AS imei, c_name AS subscriber_name, c_mktsegment AS circle
  FROM customer""")

view("f_ledger", """
  SELECT 'L' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
      || CAST(round(l_extendedprice * 100) AS BIGINT) AS txn_id,
    'C' || o_custkey AS account_no, 'C' || o_custkey AS customer_id, 'S' || l_suppkey AS receiver_account,
    l_extendedprice AS amount, l_extendedprice AS debit, CAST(NULL AS DOUBLE) AS credit, 'D' AS txn_type,
    CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS ts, strftime(o_orderdate, '%Y-%m-%d') AS date,
    CAST(NULL AS VARCHAR) AS time, l_returnflag AS mode
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")

# Every call seen from both of its ends, and every payment from both of its phones.
view("call_ends", """
  SELECT a_number AS phone, cdr_id, ts, duration_sec, call_type, b_number, imei FROM f_cdr
  UNION ALL SELECT b_number, cdr_id, ts, duration_sec, call_type, b_number, imei FROM f_cdr""")
view("pay_phones", """
  SELECT txn_id, ts, sender_phone AS phone FROM f_bank
  UNION SELECT txn_id, ts, receiver_phone FROM f_bank""")
