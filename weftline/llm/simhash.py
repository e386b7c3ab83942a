"""SimHash fingerprints and near-duplicate groups found through a covering code of anchors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import computed, python_ready, stored, whole_text
from weftline.operators.graphs import components

SHINGLE, SEED, THRESHOLD = 4, 42, 4
#: Widths of the blocks that a fingerprint is cut into, from the lowest bit up.
BLOCKS = (21, 21, 22)
#: Part of each block that is covered by a perfect Hamming code; on the other bits every point is an anchor.
CODED = 15


def fingerprint(text: str) -> int:
    """Majority of the bits of the shingles' hashes; zero for a text without words."""
    words = text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(SHINGLE, len(words)) - 1
    spans = zip(starts[:len(words) - last].tolist(), ends[last:].tolist())
    hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans), "<u8", len(words) - last)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(((ones * 2 > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fingerprint as a signed 64-bit integer) of every whole text; null counts as empty."""

    python_ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), whole_text().alias("text"))
    return computed(rows, ["doc_id", "text_hash"], ["text"], lambda: lambda texts: [np.array([*map(fingerprint, texts)], np.uint64).view(np.int64)], "fingerprint long")


@lru_cache
def _syndromes() -> np.ndarray:
    """Syndrome of each value of the coded bits: the xor of the (one-based) places of its ones."""
    values = np.arange(1 << CODED)
    out = np.zeros(1 << CODED, np.int64)
    for k in range(CODED):
        out ^= np.where(values >> k & 1, k + 1, 0)
    return out


def home(block: np.ndarray) -> np.ndarray:
    """The anchor that covers a block: its nearest code word, at most one bit away, with the other bits kept."""
    s = _syndromes()[block & ((1 << CODED) - 1)]
    return block ^ np.where(s > 0, 1 << np.maximum(s - 1, 0), 0)


@lru_cache
def _patterns(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << k for k in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.int64)


def anchors_near(block: np.ndarray, width: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor within ``radius`` bits of each block."""
    at = block[:, None] ^ _patterns(width, radius)[None, :]
    rows, cols = np.nonzero(_syndromes()[at & ((1 << CODED) - 1)] == 0)
    return rows, at[rows, cols]


def placed(fingerprints: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(anchor, fp) of each fingerprint at its home anchors, and at all anchors within radius plus threshold.

    Two fingerprints at most ``threshold`` bits apart differ in at most ``threshold // len(BLOCKS)`` bits of some block, so
    there one of them lies within the covering radius (1) plus that many bits of the other's home.
    """
    radius = 1 + threshold // len(BLOCKS)

    def deal(homes: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                fp = batch["fp"].to_numpy(np.int64)
                for part in range(0, len(fp), 2048):
                    own, at = fp[part:part + 2048], 0
                    for number, width in enumerate(BLOCKS):
                        block = (own.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1)
                        at += width
                        rows, anchor = (np.arange(len(own)), home(block)) if homes else anchors_near(block, width, radius)
                        yield pd.DataFrame({"anchor": anchor | number << 32, "fp": own[rows]})
        return run

    rows = fingerprints.select(F.col("fingerprint").alias("fp"))
    return tuple(rows.mapInPandas(deal(homes), "anchor long, fp long") for homes in (True, False))


def links(fingerprints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (src, dst) of different fingerprints at most ``threshold`` bits apart, each once, src < dst.

    Spark sizes the placed rows by the fingerprints they come from, some 45 times too low; so neither side may be broadcast.
    """
    at_home, near = placed(fingerprints, threshold)
    h, r = at_home.alias("h"), near.alias("r")
    close = (F.col("h.anchor") == F.col("r.anchor")) & (F.col("h.fp") < F.col("r.fp")) & (F.bit_count(F.col("h.fp").bitwiseXOR(F.col("r.fp"))) <= threshold)
    return h.join(r.hint("merge"), close).select(F.col("h.fp").alias("src"), F.col("r.fp").alias("dst")).distinct()


def grouped(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, fingerprint), and one row for each fingerprint with its ``component`` and smallest doc_id.

    The component is any one fingerprint of the group, the same for all of it.
    """
    rows = stored(with_fingerprint(docs))
    groups = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    joined = components(stored(links(groups, threshold))).withColumnRenamed("node", "fingerprint")
    return rows, stored(groups.join(joined.hint("merge"), "fingerprint", "left").select("fingerprint", F.coalesce("component", "fingerprint").alias("component"), "least"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable over links, its own included.

    Equal fingerprints meet in one aggregate first, so copies never form pairs; only different fingerprints are compared.
    Texts without words share fingerprint zero and link like others. Repeated rows keep their own output rows; a null
    doc_id joins a group but never names it unless no other does. An empty table gives no rows; extra columns are ignored.
    """
    rows, member = grouped(docs, threshold)
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    named = member.join(least.hint("merge"), "component").select("fingerprint", "component_id")
    return rows.join(named.hint("merge"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each group, whole: that with the smallest doc_id (then text hash; ids before nulls).

    Identical rows count as one. Columns are those of ``docs``, whatever their names.
    """
    rows, member = grouped(docs, threshold)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    best = rows.groupBy("fingerprint").agg(F.min(order).alias("f"))
    first = member.join(best.hint("merge"), "fingerprint").groupBy("component").agg(F.min("f").alias("f")).select("f.*")
    names = ["no_id", "id", "own"]
    key = lambda ident, own: [ident.isNull().alias(names[0]), F.coalesce(ident, F.lit(0).cast("long")).alias(names[1]), own.alias(names[2])]
    # plain keys, so that join and dropDuplicates share one shuffle of the texts; as at any size, neither side is broadcast
    kept = docs.select(F.struct("*").alias("row"), *key(F.col("doc_id"), F.xxhash64("text"))).join(first.select(*key(F.col("doc_id"), F.col("text_hash"))).hint("merge"), names, "left_semi")
    return kept.dropDuplicates(names).select("row.*")


def duplicate_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
