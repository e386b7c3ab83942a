"""Token counts by a two-tier table of pre-token lengths, without moving a pre-token between tasks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import python_ready, whole_text
from weftline.llm.tokens import Lengths, loaded


def frequent_lengths(docs: DataFrame, tokenizer: str, entries: int = 50_000) -> dict[str, int]:
    """The broadcast tier: lengths of the ``entries`` most frequent pre-tokens of at most 32 characters, counted over all texts.

    Each task counts in a table that is cut back to its ``entries`` commonest names whenever it holds four times as many, and passes on
    an eighth of ``entries`` at most; only those names are summed. The tier saves time alone: what it lacks is encoded where it is met.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, seen = loaded(Lengths, tokenizer), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if tool.plain(text):
                    seen.update(p for p in tool.split(text) if len(p) <= 32)
            if len(seen) > 4 * entries:
                seen = Counter(dict(seen.most_common(entries)))
        top = [(p, n) for p, n in seen.most_common(entries // 8) if n > 1]
        tool.learn({p for p, _ in top})
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64()), pa.array([tool.known[p] for p, _ in top], pa.int32())], names=["piece", "n", "tokens"])

    each = docs.select(whole_text().alias("text")).mapInArrow(count, "piece string, n long, tokens int")
    rows = each.groupBy("piece", "tokens").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(entries).select("piece", "tokens").collect()
    return {r["piece"]: r["tokens"] for r in rows}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """Every row with ``n_bytes``, ``n_tokens`` and ``over_limit``; the order and partitions of the input stay.

    Null and empty texts have no bytes and no tokens. Repeated rows are counted each. An empty table gives an empty one.
    Extra columns pass through, except those named as the results, which are replaced.
    """
    spark = docs.sparkSession
    python_ready(spark)
    base = spark.sparkContext.broadcast(frequent_lengths(docs, tokenizer))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = loaded(Lengths, tokenizer)
        tool.seed(base.value)
        for texts in batches:
            yield pd.Series([sum(tool.values(t)) for t in texts], dtype="int64")

    kept = [f"`{c}`" for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    out = docs.select(*kept, F.octet_length(whole_text()).cast("long").alias("n_bytes"), count(whole_text()).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def count_report(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    return token_counts(docs.select("doc_id", "text"), tokenizer, limit).select("doc_id", "n_bytes", "n_tokens", "over_limit")
