"""Columns read from payment narrations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bank names looked for in a narration, with the label given to each.
BANK_NAMES = (
    "axis bank", "hdfc bank", "icici bank", "kotak mahindra", "kotak bank",
    "yes bank", "bandhan bank", "federal bank", "punjab national bank",
    "pnb", "union bank", "uco bank", "bank of baroda", "state bank of india",
    "sbi", "canara bank", "central bank of india", "indian bank",
    "bank of india", "idbi", "idbi bank", "utkarsh", "city union",
    "rbl bank", "au bank", "bank of maharashtra", "baroda", "indusind",
    "dbs bank", "idfc first", "equitas", "sbm bank",
)
BANK_LABELS = {"pnb": "Punjab National Bank", "sbi": "State Bank of India", "baroda": "Bank of Baroda"}

# Fixed values: (mode, texts that name it), first match wins.
MODE_WORDS = (
    ("UPI", ("upi",)), ("IMPS", ("imps",)), ("NEFT", ("neft",)), ("RTGS", ("rtgs",)), ("NACH", ("nach",)),
    ("ECS", ("ecs",)), ("ATM", ("atmcash", " at atm")), ("POS", ("pos", "swipe")), ("CHEQUE", ("cheque", "chq")),
    ("CASH", ("cash",)), ("MBB", ("mbb", "mobile banking")),
)

# Category words.
CATEGORY_WORDS = (
    ("Food", ("SWIGGY", "ZOMATO", "RESTAURANT", "FOOD", "CAFE")),
    ("Shopping", ("AMAZON", "FLIPKART", "MYNTRA", "SHOP")),
    ("Salary", ("SALARY", "SAL", "PAYROLL")),
)
LOAN_WORDS = ("LOAN", "EMI", "FINANCE")

# Patterns.
UPI_FULL = r"(?i)upi[/\\]p2[am][/\\]([^/\\]+)[/\\]([^/\\]+)[/\\]([^/\\]+)"
UPI_REF = r"(?i)upi[/\\]p2[am][/\\]([^/\\]+)"
VPA = r"([\w.\-]+@[\w.\-]+)"
PHONE10 = r"(?<!\d)(?:\+?91[\s-]?)?([6-9]\d{9})(?!\d)"
RRN = r"(?i)rrn:?\s*(\d{10,14})"
UTR = r"(?i)utr:?\s*([A-Za-z0-9]{12,22})"
NEFT_ACCOUNT = r"(?i)neft[/\\]?\s*([A-Za-z0-9*Xx]{9,18})"
IMPS_ACCOUNT = r"(?i)imps[/\\]?\s*([A-Za-z0-9*Xx]{9,18})"
UPI_MERCHANT = r"UPI-(.*?)-(?:GPAY|PHONEPE|PAYTM|BHIM|Q\d+|[\w\.]+@\w+)"
UPI_P2M = r"UPI[/\\]P2[MA][/\\]([^/\\]+)"
TRANSFER_NAME = r"(NEFT|RTGS|IMPS)-[A-Z0-9]+-(.*?)-"


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """First match or NULL."""
    m = F.regexp_extract(text, pattern, group)
    return F.when(m != "", m)


def payment_mode(narration: Column) -> Column:
    low = F.lower(narration)
    out = None
    for mode, words in MODE_WORDS:
        cond = _any(low, words)
        if mode == "ATM":
            cond = cond | low.startswith("atm")
        out = F.when(cond, mode) if out is None else out.when(cond, mode)
    return out


def counterparty_bank(narration: Column) -> Column:
    """Longest bank name that occurs."""
    low = F.lower(narration)
    out = None
    for name in sorted(BANK_NAMES, key=lambda n: (-len(n), n)):
        label = BANK_LABELS.get(name, name.title())
        cond = F.contains(low, F.lit(name))
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def upi_parts(narration: Column) -> dict[str, Column]:
    """UPI id, reference, name and the first ten-digit phone."""
    loose = F.filter(F.transform(F.regexp_extract_all(narration, F.lit(VPA), F.lit(1)), F.lower),
                     lambda v: ~F.split_part(v, F.lit("@"), F.lit(1)).rlike(r"^\d+$"))
    return {
        "upi_id": F.coalesce(found(narration, UPI_FULL, 3), F.try_element_at(loose, F.lit(1))),
        "upi_ref": F.coalesce(found(narration, UPI_FULL, 1), found(narration, UPI_REF)),
        "name": found(narration, UPI_FULL, 2),
        "phone": F.concat(F.lit("91"), found(narration, PHONE10)),
    }


def reference(narration: Column) -> Column:
    return F.coalesce(found(narration, RRN), found(narration, UTR))


def account_in(narration: Column) -> Column:
    return F.coalesce(found(narration, NEFT_ACCOUNT), found(narration, IMPS_ACCOUNT))


def enrichment(narration: Column, debit: Column) -> dict[str, Column]:
    """Merchant, category, gateway, flags and confidence."""
    up = F.upper(F.coalesce(narration, F.lit("")))
    merchant = F.coalesce(F.trim(found(up, TRANSFER_NAME, 2)), F.trim(found(up, UPI_P2M)), F.trim(found(up, UPI_MERCHANT)))
    gateway = (F.when(_any(up, ("ATM", "CASH")), "ATM/CASH")
               .otherwise(F.coalesce(found(up, TRANSFER_NAME, 1),
                                     F.when(up.rlike(UPI_P2M) | up.rlike(UPI_MERCHANT), "UPI"))))
    category = None
    for label, words in CATEGORY_WORDS:
        category = F.when(_any(up, words), label) if category is None else category.when(_any(up, words), label)
    category = category.otherwise("Unknown")
    return {
        "merchant_name": merchant, "merchant_category": category, "payment_gateway": gateway,
        "confidence_score": F.when(merchant.isNotNull() & (merchant != ""), 95).otherwise(50),
        "salary_flag": (category == "Salary").cast("int"),
        "loan_flag": ((category == "Unknown") & _any(up, LOAN_WORDS)).cast("int"),
        "cash_burst_flag": (F.contains(up, F.lit("ATM")) & (F.coalesce(debit, F.lit(0.0)) > 20000)).cast("int"),
    }


# Short codes and the texts that name each bank.
BANK_CODES = (
    ("SBI", ("SBI", "STATE BANK OF INDIA")), ("HDFC", ("HDFC",)), ("ICICI", ("ICICI", "ICIC")), ("AXIS", ("AXIS", "UTIB")),
    ("PNB", ("PNB", "PUNB")), ("KOTAK", ("KOTAK",)), ("BOB", ("BOB",)), ("CANARA", ("CANARA",)), ("UNION", ("UNION",)),
    ("PAYTM", ("PAYTM", "PYTM")), ("YES BANK", ("YES BANK",)),
)


def bank_code(name: Column) -> Column:
    up = F.upper(F.coalesce(name, F.lit("")))
    out = None
    for code, words in BANK_CODES:
        out = F.when(_any(up, words), code) if out is None else out.when(_any(up, words), code)
    return out.otherwise("OTHER BANK")


def channel(mode: Column, narration: Column) -> Column:
    """Mode when known, else what the narration says, else OTHER."""
    return F.coalesce(F.nullif(mode, F.lit("")), payment_mode(narration), F.lit("OTHER"))


def counterparty_label(name: Column, narration: Column) -> Column:
    """Known name, else the name part of a slash-separated narration, else its first two words."""
    parts = F.split(narration, "/")
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.nullif(F.trim(F.try_element_at(parts, F.lit(4))), F.lit("")),
                      F.array_join(F.slice(F.split(narration, " "), 1, 2), " "))
