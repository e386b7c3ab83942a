"""Fixed-length training sequences filled along a space-filling curve, so that neighbours on it share a sequence."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import computed, positions, python_ready, stored, whole_text
from weftline.llm.hilbert import hilbert_numpy
from weftline.llm.tokens import Encoder, loaded

DIMENSIONS, BITS, END = 4, 8, 0


@lru_cache
def signs(ids: int) -> np.ndarray:
    """A row of +1 and -1 for each token id below ``ids``, by hashing."""
    x = np.arange(1, ids + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return ((x[:, None] >> np.arange(DIMENSIONS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1


def curve_point(ids: np.ndarray, vocabulary: int) -> np.ndarray:
    """Quantised projection of the hashed vector of a document's distinct tokens."""
    distinct = np.unique(ids)
    x = signs(vocabulary)[distinct].sum(0) / max(1.0, np.sqrt(len(distinct)))
    return np.minimum((1 << BITS) - 1, ((np.tanh(x / 2) + 1) / 2 * (1 << BITS)).astype(np.int64))


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n, curve, ids): token ids of the whole text, then the end id, as packed little-endian integers."""

    def encoder():
        tool = loaded(Encoder, tokenizer)
        end = np.array([END], tool.width)

        def encode(texts: list[str]) -> list:
            ids = [np.concatenate([tool.ids(t), end]) for t in texts]
            points = np.array([curve_point(x, tool.size) for x in ids]).reshape(-1, DIMENSIONS)
            return [[len(x) for x in ids], hilbert_numpy(points, BITS), [x.tobytes() for x in ids], [x.itemsize for x in ids]]

        return encode

    python_ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return computed(rows, ["doc_id"], ["text"], encoder, "n long, curve long, ids binary, wide int")


def packed(docs: DataFrame, tokenizer: str, length: int = 1024) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve, ids.

    Documents are laid end to end in the order of their Hilbert key (ties: doc_id, then input order) and the stream is cut
    every ``length`` tokens, so only the last sequence can be short. A null or empty text is the end id alone; repeated rows
    are packed each; an empty table gives no rows; extra columns are ignored. Token ids are stored once and join their
    positions by row number: the text is tokenized a single time and the global order moves only numbers.
    """
    rows = stored(encoded(docs, tokenizer).withColumn("row", F.monotonically_increasing_id()))
    order = [F.col("curve"), F.col("doc_id"), F.col("row")]
    starts = positions(rows.select("row", "n", "curve", "doc_id"), order, "n").select("row", F.col("position").alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            out = []
            for doc, n, curve, ids, wide, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "curve", "ids", "wide", "at"))):
                ids = np.frombuffer(ids, f"<u{wide}").astype("<u4")
                edges = [0, *range(length - at % length, n, length), n]
                for a, b in zip(edges, edges[1:]):
                    piece = ids[a:b].tobytes()
                    out.append((doc, a, b - a, zlib.crc32(piece), n, (at + a) // length, (at + a) % length, curve, piece))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if name == "ids" else pa.int64()) for name, c in zip(names, zip(*out))], names=names)

    return rows.join(starts.hint("merge"), "row").select("doc_id", "n", "curve", "ids", "wide", "at").mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve long, ids binary")


def pack_report(docs: DataFrame, tokenizer: str, length: int = 1024) -> DataFrame:
    return packed(docs, tokenizer, length).drop("ids")
