"""From raw documents to packed training sequences, one stage after the other over all documents.

Each stage takes ``(spark, docs, sf_dir)`` and returns documents, the last one pieces of sequences. Nulls, empty and repeated
rows, empty tables and extra columns are treated as the operators' docstrings say; extra columns of the documents pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import documents, stored
from weftline.llm.packing import pack_report
from weftline.llm.personal_data import redacted
from weftline.llm.quality_rules import keep_clean
from weftline.llm.simhash import keep_first
from weftline.llm.toxicity import toxicity

#: Score from which a document counts as toxic.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional classifier, trained on the labels, scores below the limit."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", "lang")
    return toxicity(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")).where(F.col("score") < TOXIC).select("row.*")


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first rules, without the lines that fail."""
    return keep_clean(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return keep_first(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens along the curve, one row for each piece of a document."""
    return pack_report(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality rules", apply_rules), ("near duplicates", drop_near_copies), ("personal data", hide_personal_data), ("packing", pack)]

#: A trained classifier and a tokenizer are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir) if name == STAGES[-1][0] else stored(stage(spark, docs, sf_dir))
    return docs
