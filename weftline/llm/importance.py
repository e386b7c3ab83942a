"""Importance resampling: documents drawn by the ratio of two hashed n-gram models, target over raw, with Gumbel top-k."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import computed, positions, python_ready, stored, whole_text

BUCKETS, SMOOTHING, KEPT, SEED = 1 << 14, 1.0, 0.8, 17
WORD = re.compile(r"\w+|[^\w\s]+")


class Grams:
    """Counts of hashed words and word pairs, with the hashes of up to ``words`` words kept between texts."""

    def __init__(self, words: int = 1 << 18):
        self.words, self.known = words, {}

    def hashes(self, text: str) -> np.ndarray:
        found, known = WORD.findall(text.lower()), self.known
        if len(known) > self.words:
            known.clear()
        for w in found:
            if w not in known:
                known[w] = crc32(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:] * np.uint64(0x85EBCA6B)) >> np.uint64(7)
        return (np.concatenate([h, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def gram_counts(docs: DataFrame) -> pd.DataFrame:
    """Counts (kind, bucket, n) over all texts, kind 1 for target texts and 0 for all; at most ``2 * BUCKETS`` rows.

    Each task sums its own texts, so what is shuffled is one row for each bucket and task, whatever the length of the texts.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, sums = Grams(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, target in zip(batch["text"], batch["target"]):
                own = np.bincount(tool.hashes(text), minlength=BUCKETS)
                sums[0] += own
                if target:
                    sums[1] += own
        kind, bucket = np.nonzero(sums)
        yield pd.DataFrame({"kind": kind, "bucket": bucket, "n": sums[kind, bucket]})

    return docs.select(whole_text().alias("text"), "target").mapInPandas(count, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toPandas()


def log_ratios(counts: pd.DataFrame) -> np.ndarray:
    """Log of the target model's bucket probability over the raw one's, both smoothed; zero everywhere without target texts."""
    n = np.zeros((2, BUCKETS))
    n[counts["kind"], counts["bucket"]] = counts["n"]
    if not n[1].any():
        return np.zeros(BUCKETS)
    p = (n + SMOOTHING) / (n.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    return np.log(p[1] / p[0])


def resampled(docs: DataFrame, target_ids: DataFrame, kept: float = KEPT, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, mean_weight, key, rank, sampled) for each row of ``docs``.

    ``log_weight`` is the summed log ratio over the text's n-grams, ``key`` adds standard Gumbel noise that depends on the
    doc_id and ``seed`` only, and the ``kept`` share of rows with the largest keys is the sample drawn without replacement in
    proportion to the weights; ``rank`` (from 1) orders the keys, ties by doc_id. Null and empty texts weigh 0; a null doc_id is
    never a target; repeated rows have equal keys and neighbouring ranks; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    python_ready(spark)
    wanted = target_ids.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("target", F.lit(True))
    marks = stored(docs.select("doc_id").distinct().join(wanted, "doc_id", "left").where("target"))
    rows = docs.select("doc_id", whole_text().alias("text")).join(marks, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    ratios = spark.sparkContext.broadcast(log_ratios(gram_counts(rows)))

    def weigher():
        tool = Grams()

        def weigh(texts: list[str]) -> list:
            own = [tool.hashes(t) for t in texts]
            total = np.array([ratios.value[h].sum() for h in own], float)
            return [total, total / np.maximum(1, [len(h) for h in own])]

        return weigh

    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + 0.5) / float(1 << 53)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    scored = computed(rows, ["doc_id"], ["text"], weigher, "log_weight double, mean_weight double")
    keyed = stored(scored.withColumn("key", F.col("log_weight") - F.log(-F.log(unit))))
    ranked = positions(keyed, [F.col("key").desc(), F.col("doc_id")])
    return ranked.select("doc_id", "log_weight", "mean_weight", "key", (F.col("position") + 1).alias("rank"), (F.col("position") < F.ceil(F.col("total") * kept)).alias("sampled"))


def importance_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Target texts are those labelled as of good quality."""
    return resampled(docs, labels.where("quality = 1"))
