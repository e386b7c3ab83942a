"""Positions, running totals and fixed-length frames over time-ordered rows of a key.

A plain window over a key puts that key into one task. These helpers first give every row its
position among the rows of its key (from per-day and per-second counts), then cut positions into
blocks of fixed size. Windows run per (key, block); totals of earlier blocks come from a small table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 50_000
_DAY = 86400


def with_position(df: DataFrame, keys: Sequence[str], row_id: str, ts: str = "ts", out: str = "pos",
                  width: float = _DAY, tie_prefix: int = 0) -> DataFrame:
    """Number of rows of the same key before this one in (ts, row_id) order; NULL sorts first.

    ``ts`` may be any number; ``width`` is the span of values counted together. Where very many rows share
    one value, pass ``tie_prefix``: row ids are then counted by their first characters as well, so a tie
    is split into as many groups as there are prefixes (use an evenly spread id such as an md5).
    """
    keys = list(keys)
    kind = dict(df.dtypes)[ts]
    lowest = F.lit(float("-inf")) if kind == "double" else F.lit(-(2 ** 62)).cast("long")
    prefix = F.substring(F.col(row_id).cast("string"), 1, tie_prefix) if tie_prefix else F.lit("")
    src = df.withColumn("__o", F.coalesce(F.col(ts), lowest)).withColumn("__x", prefix)
    sec = src.groupBy(*keys, "__o", "__x").agg(F.count(F.lit(1)).alias("__n"))
    sec = sec.withColumn("__day", F.floor(F.col("__o") / width))
    in_day = W.partitionBy(*keys, "__day").orderBy("__o", "__x").rowsBetween(W.unboundedPreceding, -1)
    per_day = sec.groupBy(*keys, "__day").agg(F.sum("__n").alias("__dn"))
    days = W.partitionBy(*keys).orderBy("__day").rowsBetween(W.unboundedPreceding, -1)
    per_day = per_day.select(*keys, "__day", F.coalesce(F.sum("__dn").over(days), F.lit(0)).alias("__d0"))
    sec = (sec.withColumn("__s0", F.coalesce(F.sum("__n").over(in_day), F.lit(0)))
           .join(per_day, [*keys, "__day"])
           .select(*keys, "__o", "__x", (F.col("__s0") + F.col("__d0")).alias("__before")))
    tie = W.partitionBy(*keys, "__o", "__x").orderBy(row_id)
    return (src.withColumn("__tie", F.row_number().over(tie) - 1)
            .join(sec, [*keys, "__o", "__x"])
            .withColumn(out, F.col("__before") + F.col("__tie"))
            .drop("__o", "__x", "__tie", "__before"))


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, targets: Mapping[str, Column],
                     width: float = 1000.0) -> DataFrame:
    """Exact order statistics per key without gathering a key.

    ``targets`` maps an output name to a zero-based index expressed over ``n``, the number of values.
    Values are counted, counts are cumulated inside value chunks and then across chunks.
    """
    keys = list(keys)
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v"))
              .agg(F.count(F.lit(1)).alias("__c")).withColumn("__chunk", F.floor(F.col("__v") / width)))
    chunks = counts.groupBy(*keys, "__chunk").agg(F.sum("__c").alias("__cc"))
    over_key = W.partitionBy(*keys)
    before = over_key.orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.select(*keys, "__chunk", F.coalesce(F.sum("__cc").over(before), F.lit(0)).alias("__c0"),
                           F.sum("__cc").over(over_key).alias("n"))
    inside = W.partitionBy(*keys, "__chunk").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)
    spans = (counts.withColumn("__i0", F.coalesce(F.sum("__c").over(inside), F.lit(0)))
             .join(chunks, [*keys, "__chunk"]).withColumn("__lo", F.col("__i0") + F.col("__c0")))
    picks = [F.max(F.when((F.col("__lo") <= t) & (t < F.col("__lo") + F.col("__c")), F.col("__v"))).alias(name)
             for name, t in targets.items()]
    return spans.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def values_at_most(df: DataFrame, keys: Sequence[str], value: str, out: str = "at_most", width: float = 1000.0) -> DataFrame:
    """(keys, value, at_most, n): how many values of the key are no larger, for every distinct value."""
    keys = list(keys)
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
              .withColumn("__chunk", F.floor(F.col(value) / width)))
    chunks = counts.groupBy(*keys, "__chunk").agg(F.sum("__c").alias("__cc"))
    over_key = W.partitionBy(*keys)
    chunks = chunks.select(*keys, "__chunk", F.sum("__cc").over(over_key).alias("n"), F.coalesce(F.sum("__cc").over(
        over_key.orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__c0"))
    inside = W.partitionBy(*keys, "__chunk").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return (counts.withColumn("__i", F.sum("__c").over(inside)).join(chunks, [*keys, "__chunk"])
            .select(*keys, value, (F.col("__i") + F.col("__c0")).alias(out), "n"))


def linear_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float],
                     width: float = 1000.0) -> DataFrame:
    """Interpolated quantiles built from two neighbouring order statistics."""
    n = F.col("n")
    targets = {}
    for name, q in quantiles.items():
        targets[f"__a_{name}"] = F.floor((n - 1) * F.lit(q)).cast("long")
        targets[f"__b_{name}"] = F.ceil((n - 1) * F.lit(q)).cast("long")
    stats = order_statistics(df, keys, value, targets, width)
    for name, q in quantiles.items():
        a, b = F.col(f"__a_{name}"), F.col(f"__b_{name}")
        frac = (n - 1) * F.lit(q) - F.floor((n - 1) * F.lit(q))
        stats = stats.withColumn(name, a + (b - a) * frac)
    return stats.drop(*targets)


def with_scalars(df: DataFrame, one_row: DataFrame, out: str = "scalars") -> DataFrame:
    """Attach a one-row aggregate as a scalar subquery (a struct column), not as a join."""
    return df.withColumn(out, one_row.select(F.struct(*one_row.columns)).scalar())


def with_running(df: DataFrame, keys: Sequence[str], totals: Mapping[str, tuple[str, Column]],
                 pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """Running aggregates up to and including the row.

    ``totals`` maps an output name to ``("sum" | "max" | "min", expression)``.
    """
    keys = list(keys)
    src = df.withColumn("__b", F.floor(F.col(pos) / block).cast("long"))
    src = src.withColumns({f"__v_{n}": e for n, (_, e) in totals.items()})
    agg = {"sum": F.sum, "max": F.max, "min": F.min}
    per_block = src.groupBy(*keys, "__b").agg(*[agg[h](f"__v_{n}").alias(f"__t_{n}") for n, (h, _) in totals.items()])
    earlier = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    per_block = per_block.select(*keys, "__b", *[agg[h](f"__t_{n}").over(earlier).alias(f"__p_{n}")
                                                 for n, (h, _) in totals.items()])
    inside = W.partitionBy(*keys, "__b").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    out = src.join(per_block, [*keys, "__b"])
    out = out.withColumns({f"__r_{n}": agg[h](f"__v_{n}").over(inside) for n, (h, _) in totals.items()})
    combine = {
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b),
    }
    out = out.withColumns({n: combine[h](F.col(f"__p_{n}"), F.col(f"__r_{n}")) for n, (h, _) in totals.items()})
    return out.drop("__b", *[f"__{p}_{n}" for p in "vpr" for n in totals])


def with_trailing_rows(df: DataFrame, keys: Sequence[str], size: int, columns: Mapping[str, tuple[str, Column]],
                       pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """Aggregates over the last ``size`` rows including the current one.

    ``columns`` maps a name to ``("mean"|"std"|"max"|"lag", expression)``. The last ``size`` rows of a
    block are copied into the next block as context and dropped after the window.
    """
    keys = list(keys)
    carry = max(size, 1)
    b = F.floor(F.col(pos) / block).cast("long")
    late = F.col(pos) % block >= block - carry
    homes = F.when(late, F.array(b, b + 1)).otherwise(F.array(b))
    src = df.withColumns({f"__v_{n}": e for n, (_, e) in columns.items()}).withColumn("__b", F.explode(homes))
    w = W.partitionBy(*keys, "__b").orderBy(pos)
    frame = w.rowsBetween(-(size - 1), 0)
    make = {"mean": lambda c: F.avg(c).over(frame), "std": lambda c: F.stddev_pop(c).over(frame),
            "max": lambda c: F.max(c).over(frame), "lag": lambda c: F.lag(c, 1).over(w)}
    out = src.withColumns({n: make[h](f"__v_{n}") for n, (h, _) in columns.items()})
    return out.where(F.col("__b") == b).drop("__b", *[f"__v_{n}" for n in columns])
