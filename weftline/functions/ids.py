"""Identifier columns: phones, devices, addresses, case ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JUNK_IDS = ("", "-", "0")


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~t.isin("", "-"), t)


def digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def phone(raw: Column) -> Column:
    """Canonical ``91`` + ten digits starting 6-9, else NULL."""
    d = digits(raw)
    short = F.nullif(F.regexp_extract(d, r"^0?([6-9]\d{9})$", 1), F.lit(""))
    return F.concat(F.lit("91"), F.coalesce(F.nullif(F.regexp_extract(d, r"^91([6-9]\d{9,10})$", 1), F.lit("")), short))


def phone_key(raw: Column) -> Column:
    """Last ten digits, used to link datasets that write numbers differently."""
    d = digits(raw)
    d = F.when((F.length(d) >= 12) & d.startswith("91"), F.substring(d, 3, 100)).otherwise(d)
    return F.when(F.length(d) >= 10, F.right(d, F.lit(10)))


def phone_lenient(raw: Column) -> Column:
    """``91`` + ten digits without the leading-digit test."""
    d = digits(raw)
    return (F.when(F.length(d) == 10, F.concat(F.lit("91"), d))
            .when((F.length(d) == 12) & d.startswith("91"), d))


def device(raw: Column) -> Column:
    d = digits(raw)
    return F.when(~d.isin(*JUNK_IDS), d)


def ip(raw: Column) -> Column:
    s = F.regexp_replace(F.trim(raw), "^['\"]+|['\"]+$", "")
    return F.when(s.rlike("^[0-9a-fA-F:./]+$"), F.lower(s))


def case_code(txn_id: Column) -> Column:
    return F.upper(F.substring(F.sha2(txn_id, 256), 1, 8))
