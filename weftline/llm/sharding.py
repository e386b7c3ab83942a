"""Shards along a Hilbert curve over quantised metadata, so that readers can skip files on any of its dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import positions, stored
from weftline.llm.hilbert import hilbert_column


def _ordered_code(df: DataFrame, names: list[str]) -> list[Column]:
    """Numbers that keep the order of the columns' values; strings by seven bytes after the prefix that all share."""
    text = [n for n in names if isinstance(df.schema[n].dataType, T.StringType)]
    ends = df.agg(*[f(F.col(f"`{n}`")).alias(f"{f.__name__}_{i}") for i, n in enumerate(text) for f in (F.min, F.max)]).first() if text else None
    codes = []
    for n in names:
        if n not in text:
            codes.append(F.col(f"`{n}`").cast("double"))
            continue
        low, high = ((ends[f"{f}_{text.index(n)}"] or "").encode() for f in ("min", "max"))
        shared = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        seven = F.hex(F.substring(F.col(f"`{n}`").cast("binary"), shared + 1, 7))
        codes.append(F.conv(F.rpad(seven, 14, "0"), 16, 10).cast("double"))
    return codes


def curve_shards(rows: DataFrame, dimensions: list[str], ties: list[str], shards: int = 24, bits: int = 4) -> DataFrame:
    """Rows with ``curve`` (Hilbert index), ``shard`` (0 to ``shards`` - 1) and ``slot`` (place in the shard).

    Each dimension is cut into ``2**bits`` levels of about equal count (quantiles of all rows); rows are ordered by the
    curve, then by ``ties``, and the order is cut into runs whose row counts differ by at most one. Nulls form the lowest
    level and sort first. Equal rows take neighbouring slots. An empty table gives an empty table. Other columns pass through;
    ``curve``, ``shard``, ``slot``, ``position``, ``total`` and names that begin with an underscore are replaced.
    """
    own = [c for c in rows.columns if c not in ("curve", "shard", "slot", "position", "total") and not c.startswith("_")]
    table = stored(rows.select(*[f"`{c}`" for c in own]))
    every = [f"`{c}`" for c in own]
    coded = table.select(*every, *[c.alias(f"_code{i}") for i, c in enumerate(_ordered_code(table, dimensions))])
    top = 1 << bits
    cuts = coded.agg(*[F.percentile_approx(f"_code{i}", [k / top for k in range(1, top)], 10_000).alias(str(i)) for i in range(len(dimensions))]).first()
    levels = [sum((F.when(F.col(f"_code{i}") > b, 1).otherwise(0) for b in cuts[i] or []), F.lit(0)) for i in range(len(dimensions))]
    keyed = coded.select(*every, F.array(*levels).alias("_levels")).select(*every, hilbert_column(F.col("_levels"), len(dimensions), bits).alias("curve"))
    placed = positions(keyed, [F.col("curve"), *[F.col(f"`{t}`") for t in ties]])
    first = F.expr(f"(shard * total) div {shards}")
    shard = F.expr(f"cast((position * {shards} + {shards} - 1) div total as int)")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("position") - first).drop("position", "total")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in the order of their slots."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Size, checksum and place of every document; null texts count as empty ones of no bytes."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "lang", "source")
    out = curve_shards(rows, ["lang", "source", "size", "doc_id"], ["doc_id", "text_crc32"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
