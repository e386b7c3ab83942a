"""Exact running median, for keys of any size.

Keys with few rows go through two heaps, one group at a time. A key with more rows is never gathered:
all its prefixes search for their middle values together, one bit of the value rank per round, with
block-wise running counts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.ordering import with_position, with_running
from weftline.session import cut, ship_package

SMALL = 20_000


def _heaps(values: Iterator[float]) -> list[float]:
    low: list[float] = []   # negated
    high: list[float] = []
    out = []
    for v in values:
        heapq.heappush(high, -heapq.heappushpop(low, -v))
        if len(high) > len(low):
            heapq.heappush(low, -heapq.heappop(high))
        out.append(-low[0] if len(low) > len(high) else (high[0] - low[0]) / 2.0)
    return out


def _small(rows: DataFrame) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        return pd.DataFrame({"key": pdf["key"], "pos": pdf["pos"], "median": _heaps(pdf["value"])})

    return rows.groupBy("key").applyInPandas(run, "key string, pos long, median double")


def _large(rows: DataFrame) -> DataFrame:
    """Binary search over value ranks for every prefix at once."""
    ranked = cut(with_position(rows.withColumn("__id", F.lpad(F.col("pos").cast("string"), 20, "0")), ["key"], "__id", ts="value", out="r", width=1000.0)
                 .select("key", "pos", "value", "r"))
    top = ranked.agg(F.max("r")).first()[0]
    if top is None:
        return rows.select("key", "pos", F.col("value").alias("median"))
    two = F.explode(F.array(F.floor(F.col("pos") / 2), F.floor((F.col("pos") + 1) / 2)))
    asks = ranked.select("key", "pos", two.alias("k")).withColumn("q", F.row_number().over(_by_prefix())).withColumn("node", F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    for bit in range(max(int(top).bit_length(), 1) - 1, -1, -1):
        items = ranked.select("key", F.shiftright("r", bit + 1).alias("node"), (F.col("pos") * 4).alias("at"), F.expr(f"1 - (shiftright(r, {bit}) & 1)").cast("long").alias("left"),
                              F.lit(None).cast("long").alias("k"), F.lit(None).cast("int").alias("q"))
        marks = asks.select("key", "node", (F.col("pos") * 4 + F.col("q")).alias("at"), zero.alias("left"), "k", F.col("q").cast("int").alias("q"))
        seen = with_running(items.unionByName(marks), ["key", "node"], {"lefts": ("sum", F.col("left"))}, pos="at", block=200_000).where("q is not null")
        right = F.col("k") >= F.col("lefts")
        asks = cut(seen.select("key", F.floor(F.col("at") / 4).alias("pos"), "q", (F.col("node") * 2 + right.cast("long")).alias("node"),
                               F.when(right, F.col("k") - F.col("lefts")).otherwise(F.col("k")).alias("k")))
    hit = asks.select("key", "pos", F.col("node").alias("r")).join(ranked.select("key", "r", "value"), ["key", "r"])
    return hit.groupBy("key", "pos").agg(F.avg("value").alias("median"))


def _by_prefix():
    from pyspark.sql import Window as W
    return W.partitionBy("key", "pos").orderBy("k")


def running_median(df: DataFrame, key: str, value: str, pos: str = "pos", small: int = SMALL) -> DataFrame:
    """(key, pos, median) of all values of the key up to and including each position."""
    ship_package(df.sparkSession)
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(pos).cast("long").alias("pos"), F.col(value).cast("double").alias("value"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    few = rows.join(sizes.where(F.col("n") <= small).select("key"), "key")
    many = rows.join(sizes.where(F.col("n") > small).select("key"), "key")
    out = _small(few)
    # the search costs a dozen jobs, so it only runs where a large key exists
    if not sizes.where(F.col("n") > small).isEmpty():
        out = out.unionByName(_large(many))
    return out.select(F.col("key").alias(key), F.col("pos").alias(pos), "median")
