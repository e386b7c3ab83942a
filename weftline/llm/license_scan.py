"""License scan: ordered signature rules behind plain-text gates, overlaps resolved by level and containment.

DataFrame operations only. Positions are words of the lower-cased text, from zero, ends exclusive.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import stored, whole_text
from weftline.llm.license_rules import LEVELS, Rule, rules

#: Phrases that the base counts, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Confidence of a base phrase on its own.
BASE_CONFIDENCE = 0.5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised(text: Column) -> Column:
    """Lower-cased words with one space before each; empty without words.

    Other letters are lower-cased with A-Z: no word boundary and no phrase of plain letters depends on them, and it is cheaper.
    """
    words = F.btrim(F.regexp_replace(F.lower(text), SEPARATORS, " "), F.lit(" "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words))


def word_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def prefilter(signatures: list[Rule]) -> str:
    """One pattern that finds whether a text holds any gate or base phrase; all of them start at a word."""
    starts: dict[str, set[str]] = {}
    for gate in {r.gate for r in signatures} | set(BASE):
        starts.setdefault(gate[0], set()).add(re.escape(gate[1:]))
    return " (?:" + "|".join(f"{c}(?:{'|'.join(sorted(rest))})" for c, rest in sorted(starts.items())) + ")"


def gated(signatures: list[Rule]) -> Column:
    """The rules as one constant: array of (gate, rules), so that a text is searched once for each gate."""
    gates: dict[str, list] = {}
    for at, rule in enumerate(signatures):
        gates.setdefault(rule.gate, []).append({"rule": at, "pattern": rule.pattern})
    table = [{"gate": f" {g}", "rules": r} for g, r in gates.items()]
    return F.from_json(F.lit(json.dumps(table)), "array<struct<gate:string,rules:array<struct<rule:int,pattern:string>>>>")


def matches(text: Column, signatures: list[Rule]) -> Column:
    """array of (rule, gaps, sizes): words between and in the matches of each rule that has any."""

    def found(rule: Column) -> Column:
        measured = lambda cut: F.struct(rule["rule"].alias("rule"), F.transform(cut, word_count).alias("gaps"), F.transform(F.regexp_extract_all(text, rule["pattern"], F.lit(0)), word_count).alias("sizes"))
        return F.transform(F.filter(F.array(F.split(text, rule["pattern"], -1)), lambda cut: F.size(cut) > 1), measured)

    opened = F.filter(gated(signatures), lambda g: F.contains(text, g["gate"]))
    return F.flatten(F.transform(F.flatten(F.transform(opened, lambda g: g["rules"])), found))


def measured(docs: DataFrame, signatures: list[Rule]) -> DataFrame:
    """One row for each row of ``docs``, without its text: ``row``, doc_id, counts of the base, and raw matches."""
    n = F.col("n_words")
    df = docs.select("doc_id", normalised(whole_text()).alias("norm"))
    df = df.select("doc_id", "norm", word_count(F.col("norm")).cast("long").alias("n_words"), F.when(F.col("norm").rlike(prefilter(signatures)), F.col("norm")).alias("open"))
    cuts = {p: f"_cut{i}" for i, p in enumerate(BASE)}
    df = df.select("doc_id", "n_words", "open", *[F.when(F.contains("open", F.lit(f" {p}")), F.split("open", f" {p}(?![^ ])", -1)).alias(c) for p, c in cuts.items()])
    hit = {p: F.size(c) > 1 for p, c in cuts.items()}
    first = [F.when(hit[p], word_count(F.element_at(c, 1))).cast("long") for p, c in cuts.items()]
    last = [F.when(hit[p], n - word_count(F.element_at(c, -1)) - len(p.split())).cast("long") for p, c in cuts.items()]
    count = sum((F.when(hit[p], F.size(c) - 1).otherwise(0) for p, c in cuts.items()), F.lit(0)).cast("long")
    labels = F.array_compact(F.array(*[F.when(hit[p], F.lit(label)) for p, label in BASE.items()]))
    return df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", count.alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"),
                     F.array_sort(labels).alias("base"), F.when(F.col("open").isNotNull(), matches(F.col("open"), signatures)).alias("raw"))


def resolved(rows: DataFrame, signatures: list[Rule]) -> DataFrame:
    """(row, rule, start, end, form, label, confidence, kept) of all matches in ``rows`` of ``measured``.

    A match falls to another that contains it and is stronger: of a lower level, or of its level and longer, or of equal
    span and an earlier rule. Matches that only overlap both stay.
    """
    name = lambda values, kind: F.element_at(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), F.col("rule") + 1)
    each = rows.select("row", F.explode("raw").alias("m")).select("row", "m.rule", F.posexplode(F.arrays_zip(F.col("m.gaps").alias("gap"), F.col("m.sizes").alias("size")))).select("row", "rule", "pos", "col.gap", "col.size")
    each = each.repartition("row")
    before = Window.partitionBy("row", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.col("size")).over(before), F.lit(0)) + F.col("gap")
    each = each.where(F.col("size").isNotNull()).select("row", "rule", start.alias("start"), (start + F.col("size")).alias("end"), name([r.level for r in signatures], "int").alias("level"))
    wider = Window.partitionBy("row").orderBy("start", F.desc("end"), "level", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(*[F.when(F.col("level") == k, F.max(F.when(F.col("level") <= k, F.col("end"))).over(wider)) for k in range(LEVELS)])
    return each.select("row", "rule", "start", "end", name([r.form for r in signatures], "string").alias("form"), name([r.label for r in signatures], "string").alias("label"),
                       name([r.confidence for r in signatures], "double").alias("confidence"), (F.coalesce(reach, F.lit(-1)) < F.col("end")).alias("kept"))


def detections(docs: DataFrame, signatures: list[Rule] | None = None) -> DataFrame:
    """Every match of a rule in the whole texts: doc_id, row, rule, start, end, form, label, confidence, kept.

    Null texts count as empty; repeated rows and null ids each have their own ``row``; extra columns are ignored.
    """
    signatures = signatures or rules()
    rows = stored(measured(docs, signatures))
    return resolved(rows, signatures).join(rows.select("row", "doc_id"), "row").select("doc_id", "row", "rule", "start", "end", "form", "label", "confidence", "kept")


def license_report(docs: DataFrame, signatures: list[Rule] | None = None) -> DataFrame:
    """One row for each row of ``docs``: base counts and labels, labels of the kept matches added, and a score.

    The score is the greatest confidence among kept matches and base phrases, 0 without any. Null texts count as empty and
    have no words; repeated rows have equal results; an empty table gives no rows; extra columns are ignored. The text is read
    once; only counts and match positions are stored and shuffled, by row.
    """
    signatures = signatures or rules()
    rows = stored(measured(docs, signatures))
    kept = resolved(rows, signatures).where("kept").groupBy("row").agg(F.collect_set("label").alias("more"), F.max("confidence").alias("best"), F.count("*").alias("n_kept"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(BASE_CONFIDENCE)).otherwise(0.0))
    return rows.drop("raw").join(kept, "row", "left").select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
                                                             F.array_join(labels, ",").alias("labels"), score.alias("score"), F.coalesce("n_kept", F.lit(0).cast("long")).alias("n_kept"))
