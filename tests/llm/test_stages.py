"""Large ids beside nulls in every operator, and pipeline stages on messy, empty and oddly named tables."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weftline.llm import importance, order_minhash, packing, personal_data, quality_rules, sentencepiece_match, sharding, simhash, token_counts, toxicity
from weftline.llm.license_scan import license_report

BIG = [9007199254740993, 9223372036854775807, -9007199254740993, None, 3]
SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PROSE = "The quick brown fox jumps over the lazy dog near the river bank today. "
#: Names that stages use inside, and names of their results.
ODD = ["_own", "own", "_id", "id", "_no_id", "no_id", "_hash", "more", "_text", "_spans", "row", "_q_words", "_settled", "n_words", "kept", "cleaned", "score", "toxic_by_language", "text_hash", "component", "fp", "anchor", "every", "base"]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(BIG[0], 1, 0), (BIG[4], 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def big(spark):
    rows = [(i, f"{PROSE}number {k} {'word%d ' % k * k}", "en", "s", 10) for k, i in enumerate(BIG)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


@pytest.mark.parametrize("name", ["packing", "minhash", "counts", "toxicity", "personal", "sharding", "pieces", "simhash", "importance", "rules", "license"])
def test_ids_above_two_to_the_53(big, labels, name):
    run = {"packing": lambda: packing.pack_report(big, BPE), "minhash": lambda: order_minhash.fingerprint_report(big), "counts": lambda: token_counts.count_report(big, BPE),
           "toxicity": lambda: toxicity.toxicity_report(big, labels), "personal": lambda: personal_data.personal_report(big), "sharding": lambda: sharding.shard_report(big),
           "pieces": lambda: sentencepiece_match.piece_report(big, PIECES), "simhash": lambda: simhash.duplicate_report(big), "importance": lambda: importance.importance_report(big, labels),
           "rules": lambda: quality_rules.rules_report(big), "license": lambda: license_report(big)}[name]
    assert {r.doc_id for r in run().select("doc_id").collect()} == set(BIG)


def documents(spark):
    prose = " ".join(f"Sentence {k} tells {k * k} stories about the place called {k}ville." for k in range(12))
    texts = [None, "", prose, prose, prose + " And so on. Mail a.b@c-d.org now.", "x " * 20000, prose + " Another ending stands here."]
    rows = [(i if i != 6 else None, t, "en" if i % 2 else None, None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[2], rows[4], rows[6]], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_keeps_odd_columns(spark, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = documents(spark)
    plain = run(spark, docs, SF)
    odd = run(spark, docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in ODD}), SF)
    key = ["doc_id", "text", "lang", "source", "n_chars"] if stage != "packing" else ["doc_id", "start", "length", "ids_crc32"]
    order = lambda df: sorted((tuple(r) for r in df.select(*key).collect()), key=str)
    assert order(odd) == order(plain) and plain.count() > 0
    if stage != "packing":
        assert odd.columns == docs.columns + ODD
        for r in odd.collect():
            assert all(r[c] == c + ("-" if r.doc_id is None else str(r.doc_id)) for c in ODD)


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_an_empty_table(spark, stage):
    assert dict(corpus_pipeline.STAGES)[stage](spark, documents(spark).where("false"), SF).count() == 0


def test_repeated_windows_are_compared_by_their_words(spark):
    words = [f"w{k % 700}" for k in range(2100)] + [f"u{k}" for k in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    assert quality_rules.rules_report(docs).first().n_repeat_words == 2100


def test_the_frequent_tier_reads_all_partitions(spark):
    docs = spark.createDataFrame([(k, ("alpha " if k < 90 else "omega ") * 50) for k in range(100)], "doc_id long, text string").repartitionByRange(4, "doc_id")
    known = token_counts.frequent_lengths(docs, BPE, 80)
    assert any("alpha" in p for p in known) and any("omega" in p for p in known)
