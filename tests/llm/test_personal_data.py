"""Personal data on texts where a shortcut of the search could lose spans."""

import hashlib
import re

from weftline.llm import personal_data


def test_card_of_digits_that_stand_alone(spark):
    texts = ["card 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 thanks", "card 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 2", "room 4 , row 1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in personal_data.personal_report(docs).collect()}
    assert [out[i]["n_card"] for i in range(4)] == [1, 1, 0, 0]
    assert out[0]["base_sha256"] == hashlib.sha256(b"card:5:36").hexdigest() and out[1]["spans"] == "card:5:36"
    hidden = {r["doc_id"]: r["text"] for r in personal_data.redacted(docs).collect()}
    assert hidden[0] == "card [CARD] thanks" and hidden[1] == "card [CARD]" and hidden[3] == texts[3]


def plain_words(text, spans):
    """Last two words before each (start, end), earlier groups of overlapping spans replaced."""
    out, groups = [], []
    for a, b in sorted(spans):
        if groups and a < groups[-1][1]:
            groups[-1][1] = max(groups[-1][1], b)
        else:
            groups.append([a, b])
        before, at = "", 0
        for x, y in groups[:-1]:
            before, at = f"{before}{text[at:x]} {personal_data.MARK} ", y
        out.append((before + text[at:a]).split()[-2:])
    return out


def test_context_comes_from_the_whole_text(spark):
    long = "w" * 90
    texts = ["ids AB123456 or AB234567", "AB123456", "AB123456,AB123457,AB123458", "see v2beta7 now AB123456, AB123457 AB123458", f"{long} {long}x \n AB123456", "mail a1@b.example.com 10.0.0.1 AB123456",
             "x +1 (265) 555-5428 y +1 (265) 555-5428 10.0.0.1@c.example.com AB123456 ", "é😀 日本 AB123456 é AB123457", "one AB12345678 | AB12345679 | 4111 1111 1111 1111 | z AB12345670"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    contexts = {r["doc_id"]: sorted([*r["base"], *r["others"]]) for r in personal_data.found_spans(docs).collect()}
    for i, text in enumerate(texts):
        words = plain_words(text, [(s["start"], s["end"]) for s in contexts[i]])
        want = [re.sub("[0-9]", "0", " ".join(w).lower()) if len(w) == 2 else None for w in words]
        assert len(want) > 0 and [s["pattern"] for s in contexts[i]] == want, (text, contexts[i], want)
    assert [s["pattern"] for s in contexts[0]] == [None, "<id> or"] and contexts[3][0]["pattern"] == "v0beta0 now"


def test_identifier_after_another_is_discovered(spark):
    texts = [f"please write to user{i}@mail{i}.example.com or info{i}@mail{i}.example.com today." for i in range(12)] + ["please ask AB123456 or agent007.zero today."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["spans"] for r in personal_data.personal_report(docs).collect()}[12] == "email:23:36"
