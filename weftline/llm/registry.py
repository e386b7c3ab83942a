"""Registered queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import documents
from weftline.llm.hard_negatives import negative_report
from weftline.llm.importance import importance_report
from weftline.llm.license_scan import license_report
from weftline.llm.order_minhash import fingerprint_report
from weftline.llm.packing import pack_report
from weftline.llm.personal_data import personal_report
from weftline.llm import quality_rules as rules
from weftline.llm.quality_rules import rules_report
from weftline.llm.sentencepiece_match import piece_report
from weftline.llm.sharding import shard_report
from weftline.llm.simhash import duplicate_report
from weftline.llm.token_counts import count_report
from weftline.llm.toxicity import toxicity_report
from weftline.llm.vector_codes import code_report

QUERIES, SQL = {}, {}

RULES_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w, string_split(text, chr(10)) AS lines FROM t),
l AS (SELECT *, list_filter(lines, lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS full_lines,
  list_filter(lines, lambda x: NOT regexp_matches(x, '[^ \t\n\v\f\r]') OR NOT (
    (NOT regexp_matches(x, '{terminal}') AND len(string_split_regex(x, '[ \t\n\v\f\r]+')) < 8)
    OR length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) > {line_symbols} * length(regexp_replace(x, '[ \t\n\v\f\r]', '', 'g'))
    OR len(regexp_extract_all(x, '[!?]{{2,}}')) > {doubled} * len(string_split_regex(x, '[ \t\n\v\f\r]+'))
    OR (length(x) - length(regexp_replace(x, '{separators}', '', 'g')) >= 3 AND (length(x) - length(regexp_replace(x, '{separators}', '', 'g'))) * 4 > len(string_split_regex(x, '[ \t\n\v\f\r]+')))
    OR (length(x) <= 200 AND regexp_matches(lower(x), '{boilerplate}')))) AS good FROM a),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
c AS (SELECT l.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(lines) - len(good) AS lines_removed,
  length(regexp_replace(array_to_string(good, ' '), '[ \t\n\v\f\r]', '', 'g')) AS kept_chars FROM l LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {min_words} OR 100 * n_repeat_words > {max_repeated} * n_words AS base_failed,
  NOT (n_words < {min_words} OR 100 * n_repeat_words > {max_repeated} * n_words) AND kept_chars >= {min_kept} * word_chars AND n_symbols <= {max_symbols} * word_chars AS kept, lines_removed FROM c""".format(
    terminal=rules.TERMINAL.replace('\\"', '"').replace("'", "''"), separators=rules.SEPARATORS, boilerplate=rules.BOILERPLATE, line_symbols=rules.MAX_LINE_SYMBOLS, doubled=rules.MAX_DOUBLED,
    min_words=rules.MIN_WORDS, max_repeated=int(100 * rules.MAX_REPEATED), min_kept=rules.MIN_KEPT, max_symbols=rules.MAX_SYMBOLS)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


@query("op1_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_report(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_token_counts")
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_report(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_sharding")
def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(documents(spark, sf_dir))


@query("op8_simhash")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_report(documents(spark, sf_dir))


@query("op10_quality_rules", RULES_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_report(documents(spark, sf_dir))


@query("op2_order_minhash")
def order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(documents(spark, sf_dir))


@query("op4_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op5_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_report(documents(spark, sf_dir))


@query("op7_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_report(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_importance")
def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op12_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(documents(spark, sf_dir))


@query("op13_vector_codes")
def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(embeddings(spark, sf_dir))


@query("op11_hard_negatives")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negative_report(embeddings(spark, sf_dir))
