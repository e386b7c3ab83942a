"""Predicates, bands and point columns shared by the scoring jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Call types that count as a call whatever the duration.
CALL_TYPES_WIDE = ("VOICE", "INCOMING", "OUTGOING", "MISSED", "SMS")
CALL_TYPES_VOICE = ("VOICE", "INCOMING", "OUTGOING")
MIN_CALL_SECONDS = 10

# Fixed values: (name, lower bounds with labels from the top) of the four band schemes.
BANDS = {
    "engine": ((85, "CRITICAL"), (70, "HIGH"), (50, "MEDIUM"), (25, "LOW"), (None, "SAFE")),
    "evidence": ((75, "CRITICAL"), (50, "HIGH"), (25, "MEDIUM"), (None, "LOW")),
    "result": ((86, "SEVERE"), (71, "CRITICAL"), (51, "HIGH"), (26, "MEDIUM"), (None, "LOW")),
    "behaviour": ((75, "CRITICAL"), (50, "HIGH"), (None, "MEDIUM")),
}


def is_call(call_type: Column, duration: Column, types: Sequence[str] = CALL_TYPES_WIDE) -> Column:
    return F.coalesce(F.upper(call_type).isin(*types), F.lit(False)) | (
        F.coalesce(duration, F.lit(0)) >= MIN_CALL_SECONDS)


def is_round(amount: Column) -> Column:
    a = F.coalesce(amount, F.lit(0.0))
    return (a >= 1000) & (a % 5000 == 0)


def band(score: Column, scheme: str = "engine") -> Column:
    *steps, (_, rest) = BANDS[scheme]
    out = None
    for bound, label in steps:
        out = F.when(score >= bound, label) if out is None else out.when(score >= bound, label)
    return out.otherwise(rest)


def first_of(*pairs: tuple[Column, float]) -> Column:
    """Points of the first condition that holds, else 0."""
    out = None
    for cond, pts in pairs:
        out = F.when(cond, F.lit(float(pts))) if out is None else out.when(cond, F.lit(float(pts)))
    return out.otherwise(0.0)


def rule(when: Column, code: str, points: Column | float, reason: Column | str, weight: Column | float = 1.0) -> Column:
    """One rule as a struct, NULL when it does not fire."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(when, F.struct(F.lit(code).alias("rule"), as_col(points).cast("double").alias("points"),
                                 as_col(weight).cast("double").alias("weight"), as_col(reason).alias("reason")))


def fired(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def capped_sum(rules: Column, cap: float = 100.0) -> Column:
    """Running sum with the cap applied after every rule."""
    return F.aggregate(rules, F.lit(0.0), lambda acc, r: F.least(acc + r["points"] * r["weight"], F.lit(cap)))


def rounded_value(c: Column, digits: int) -> Column:
    """A double rounded by its value: 0.575, stored a little below, gives 0.57. F.round reads the shortest decimal and gives 0.58."""
    return F.round(c * 10 ** digits, 0) / 10 ** digits


def confidence(score: Column) -> Column:
    return rounded_value(F.least(F.lit(0.5) + score / 200.0, F.lit(0.97)), 2)


def plus(cond: Column, points: float) -> Column:
    return F.when(cond, F.lit(float(points))).otherwise(0.0)
