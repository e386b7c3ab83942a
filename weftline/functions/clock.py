"""Date, time and epoch columns. Everything is zone-free arithmetic on epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IST_OFFSET = 19800

# Accepted date layouts, tried in this order.
DATE_LAYOUTS = (
    "dd/MM/yyyy", "dd-MM-yyyy", "dd/MM/yy", "dd-MM-yy",
    "dd-MMM-yyyy", "dd-MMM-yy", "dd/MMM/yyyy", "dd/MMM/yy",
    "dd MMM yyyy", "dd-MMMM-yyyy", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd",
    "yyyyMMdd", "ddMMyyyy", "yyyy-MM-dd HH:mm:ss",
)
MISSING = ("", "-", "--", "NA", "N/A", "...")


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def iso_date(ts: Column) -> Column:
    day = F.floor(ts / 86400).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string")


def hhmmss(ts: Column) -> Column:
    sec = F.pmod(ts, F.lit(86400)).cast("int")
    return F.concat_ws(":", _two(F.floor(sec / 3600)), _two(F.floor(sec / 60) % 60), _two(sec % 60))


def utc_hour(ts: Column) -> Column:
    return F.floor(F.pmod(ts, F.lit(86400)) / 3600).cast("int")


def weekday(ts: Column) -> Column:
    """0 = Monday; day zero of the epoch was a Thursday."""
    return F.pmod(F.floor(ts / 86400) + 3, F.lit(7)).cast("int")


def ist_day(ts: Column) -> Column:
    return iso_date(ts + IST_OFFSET)


def local_hour(time: Column, ts: Column) -> Column:
    """Printed clock hour, else the hour at +05:30, else -1."""
    printed = F.when(time.rlike(r"^\d{2}"), F.substring(time, 1, 2).cast("int"))
    return F.coalesce(printed, utc_hour(ts + IST_OFFSET), F.lit(-1))


def has_clock(time: Column) -> Column:
    return F.coalesce(time.rlike(r"^\d{2}"), F.lit(False))


def odd_hour(hour: Column) -> Column:
    return (hour >= 22) | ((hour >= 0) & (hour < 6))


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``; keeps long conditional expressions small."""
    return F.try_element_at(F.transform(F.array(value), use), F.lit(1))


def parse_date(raw: Column, period_start: Column | None = None, period_end: Column | None = None) -> Column:
    """Date text to ISO text. The period settles which century or digit order is meant."""
    s = F.regexp_replace(F.regexp_replace(F.trim(raw), "^['\"]+|['\"]+$", ""), r"\s+", " ")
    # strict patterns want two-digit day and month
    padded = F.regexp_replace(F.regexp_replace(s, r"^(\d)([/\- ])", "0$1$2"), r"^(\d\d[/\-])(\d)([/\-])", "${1}0$2$3")

    def read(p: Column) -> Column:
        plain = F.coalesce(*[_guarded(p, layout) for layout in DATE_LAYOUTS],
                           *[_guarded(F.substring(p, 1, 10), d) for d in DATE_LAYOUTS[:2]],
                           *[_guarded(F.substring(p, 1, 8), d) for d in DATE_LAYOUTS[2:4]])
        if period_start is None or period_end is None:
            return plain
        lo, hi = F.to_date(period_start), F.to_date(period_end)
        compact = [F.to_date(F.try_to_timestamp(p, F.lit(f))) for f in ("ddMMyyyy", "yyyyMMdd")]
        near = [F.when(p.rlike(r"^\d{8}$") & c.between(F.date_sub(lo, 5), F.date_add(hi, 5)), c) for c in compact]
        century = F.floor(F.year(lo) / 100) * 100
        short = p.rlike(r"^\d{2}/\d{2}/\d{2}$")
        yy = F.substring(p, 7, 2).try_cast("int")
        shifts = []
        for shift in (0, -100, 100):
            text = F.concat(F.substring(p, 1, 6), F.lpad((century + yy + shift).cast("string"), 4, "0"))
            d = F.to_date(F.try_to_timestamp(text, F.lit("dd/MM/yyyy")))
            shifts.append(F.when(short & d.between(F.date_sub(lo, 400), F.date_add(hi, 400)), d))
        return F.coalesce(*near, *shifts, plain)

    return let(F.when(~padded.isin(*MISSING), padded), read).cast("string")


# The shape each layout must have before it is parsed.
_SHAPES = {
    "dd": r"\d{2}", "MMMM": "[A-Za-z]{4,}", "MMM": "[A-Za-z]{3}", "MM": r"\d{2}",
    "yyyy": r"\d{4}", "yy": r"\d{2}", "HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}",
}


def _shape(layout: str) -> str:
    out, i = "", 0
    while i < len(layout):
        token = next((t for t in sorted(_SHAPES, key=len, reverse=True) if layout.startswith(t, i)), None)
        out += _SHAPES[token] if token else layout[i]
        i += len(token) if token else 1
    return f"^{out}$"


def _guarded(s: Column, layout: str) -> Column:
    text = F.initcap(s) if "MMM" in layout else s
    if "MMM" in layout and "-" in layout or "MMM" in layout and "/" in layout:
        sep = "-" if "-" in layout else "/"
        text = F.regexp_replace(F.initcap(F.regexp_replace(s, sep, " ")), " ", sep)
    return F.when(s.rlike(_shape(layout)), F.to_date(F.try_to_timestamp(text, F.lit(layout))))


def parse_time(raw: Column) -> Column:
    """Clock text (``h:mm``, ``hh:mm:ss`` or compact ``hhmmss``) to ``HH:MM:SS``."""
    s = F.regexp_replace(F.trim(raw), "^['\"]+|['\"]+$", "")
    colon = r"(\d{1,2}):(\d{2})(?::(\d{2}))?"
    compact = r"^(\d{2})(\d{2})(\d{2})$"

    def build(pattern: str) -> Column:
        h, m = (F.regexp_extract(s, pattern, i) for i in (1, 2))
        sec = F.regexp_extract(s, pattern, 3)
        sec = F.when(sec == "", "00").otherwise(sec)
        ok = (h != "") & (h.cast("int") <= 23) & (m.cast("int") <= 59) & (sec.cast("int") <= 59)
        return F.when(ok, F.concat_ws(":", F.lpad(h, 2, "0"), m, sec))

    return F.coalesce(build(colon), build(compact))


def to_epoch(date: Column, time: Column) -> Column:
    """ISO date plus optional ``HH:MM:SS`` to seconds; unreadable clock text counts as midnight."""
    day = F.date_diff(F.try_to_timestamp(date, F.lit("yyyy-MM-dd")).cast("date"), F.lit("1970-01-01").cast("date"))
    clock = r"^(\d{2}):(\d{2}):(\d{2})"
    part = [F.coalesce(F.when(time.rlike(clock), F.regexp_extract(time, clock, i).cast("int")), F.lit(0))
            for i in (1, 2, 3)]
    return day.cast("long") * 86400 + part[0] * 3600 + part[1] * 60 + part[2]
