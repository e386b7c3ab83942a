"""License scan against a plain version in Python."""

from __future__ import annotations

import re

import pytest

from weftline.llm.license_rules import LEVELS, rules
from weftline.llm.license_scan import BASE, BASE_CONFIDENCE, SEPARATORS, detections, license_report

RULES = rules()
TEXTS = [
    None, "", "   \n\t", "plain words only", "CC BY", "cc-by cc by\nCC,BY", "CC bye, acc by, cc  BY-NC 4.0 ", "All rights reserved. All Rights Reserved",
    "This work is licensed under the GNU General Public License, version 3 or later; see https://www.gnu.org/licenses/gpl-3.0.html",
    "Released under the MIT License. Licensed under the Apache License, Version 2.0 (the License)", "SPDX-License-Identifier: LGPL-2.1-only and Apache 2.0, GPLv2+",
    "GNU Lesser General Public License v2.1, the affero general public licence", "Permit limit. mit license and BSD 3-Clause license, creative commons attribution-noncommercial 4.0 international license",
    "é cc by ü all rights reserved 日本 general public license ß", "licensed under the terms of the Mozilla Public License, v. 2.0 all rights reserved unauthorized copying of",
    "cc by " * 400 + "mit license " * 100,
]


def plain(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    starts, base = [], set()
    for phrase, label in BASE.items():
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(parts)] == parts]
        starts += at
        base |= {label} if at else set()
    norm = "".join(" " + w for w in words)
    found = []
    for k, rule in enumerate(RULES):
        for m in re.finditer(rule.pattern, norm):
            a = norm.count(" ", 0, m.start())
            found.append((rule.level, a - (a + m[0].count(" ")), a, k, a + m[0].count(" ")))
    found.sort()
    kept = []
    for x in found:
        if not any(y[2] <= x[2] and x[4] <= y[4] for y in kept):
            kept.append(x)
    score = max([RULES[x[3]].confidence for x in kept] + [BASE_CONFIDENCE] * bool(starts), default=0.0)
    labels = sorted(base | {RULES[x[3]].label for x in kept})
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(labels), score, sorted((x[2], x[4], x[3]) for x in kept)


def test_every_match_holds_its_gate_at_a_word():
    assert len({r.pattern for r in RULES}) > 300 and max(r.level for r in RULES) == LEVELS - 1
    for rule in RULES:
        gate = rule.gate.replace("licen", "licen[sc]e") if rule.gate.endswith("licen") else rule.gate
        if "(?:" not in rule.pattern.replace("(?![^ ])", ""):
            assert " " + gate in rule.pattern + " " or " " + rule.gate in rule.pattern.replace("[sc]", "s") + " ", rule


@pytest.mark.parametrize("clash", [False, True])
def test_against_a_plain_version(spark, clash):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[8]), (2**53 + 1, TEXTS[9]), (8, TEXTS[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if clash:
        from pyspark.sql import functions as F
        docs = docs.withColumns({c: F.lit("x") for c in ("row", "norm", "raw", "base", "n_words", "open", "label", "kept", "rule")})
    got = sorted((tuple(r)[:8] for r in license_report(docs).collect()), key=str)
    want = sorted(((i, *plain(t)[:7]) for i, t in rows), key=str)
    assert got == want
    if not clash:
        spans = sorted((r.doc_id, r.start, r.end, r.rule) for r in detections(docs.where("doc_id < 15")).where("kept").collect())
        assert spans == sorted((i, *s) for i, t in rows if i is not None and i < 15 for s in plain(t)[7] for _ in [0])


def test_documents_of_the_smallest_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: plain(r.text)[:7] for r in docs.collect()}
    got = {r.doc_id: tuple(r)[1:8] for r in license_report(docs).collect()}
    assert got == want and any(x[5] for x in got.values())


def test_an_empty_table(spark):
    assert license_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
