"""Amount text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: an amount token of a statement line, with an optional Cr/Dr suffix.
AMOUNT_TOKEN = r"^(?:\d{1,3}(?:,\d{3})+(?:\.\d{2,3})?|(?:[\d,]{1,12}\.\d{2,3}|\.\d{2,3}))(?:\(?[CcDd][Rr]\)?)?$"


def parse_amount(raw: Column) -> Column:
    """Leading number after commas, blanks and the rupee sign are removed; NULL when there is none."""
    s = F.regexp_replace(F.trim(raw), "[,₹ ]", "")
    return F.regexp_extract(s, r"^([+-]?\d*\.?\d+)", 1).try_cast("double")


def is_amount_token(token: Column) -> Column:
    return token.rlike(AMOUNT_TOKEN)


def suffix(token: Column) -> Column:
    return F.upper(F.regexp_extract(token, r"\(?([CcDd][Rr])\)?$", 1))
