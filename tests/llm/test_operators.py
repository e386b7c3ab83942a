"""Each operator on a messy table, held against a plain Python version."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import importance, order_minhash, packing, personal_data, quality_rules, sentencepiece_match, sharding, simhash, token_counts, toxicity
from weftline.llm.hilbert import hilbert_numpy

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, position int, shard string"


def messy_rows():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    base = prose(120)
    texts = [None, "", " \n\t", "one", "Two words", base, base, base.replace(" ", "  ", 3).upper(), base + " tail", prose(9000), "a" * 3000, "x\n" * 300, "日本語のテキスト、長い文字列。" * 20,
             "Émile 😀 \x1c\x85 it's 12½ <|endoftext|> x", "mail a.b+c@d-e.example.com, d@e.f_g@h.i 10.0.0.256 1.2.3.4.5 +1 (265) 555-5428 4111 1111 1111 1111 0000000000001.2.3.4", "1" * 5000, "a" * 4000 + "@" + "b.c" * 50,
             "repeat this line now.\n" * 40, "\n".join(prose(30) for _ in range(6)), "menu | home | about | login | " * 10, *(prose(60) for _ in range(40))]
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["s1", "s2", "", None]), 7, 0.5, 3, "x") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "id is missing here.", "en", "s1", 1, 0.1, 1, "y"), (None, None, None, None, None, None, None, None), (8, "the same id, another text.", "en", "s1", 1, 0.1, 1, "y")]
    return rows


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(messy, empty):
    tool = Tokenizer.from_file(BPE)
    want = Counter()
    for row in messy_rows():
        ids = tool.encode(row[1] or "", add_special_tokens=False).ids + [0]
        want[row[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    out = packing.packed(messy, BPE, 64).toPandas()
    assert out["ids_crc32"].tolist() == [zlib.crc32(b) for b in out["ids"]]
    order = out.sort_values(["sequence_id", "offset"])
    assert (order["sequence_id"] * 64 + order["offset"]).tolist() == np.concatenate([[0], order["length"].cumsum()[:-1]]).tolist()
    assert out.groupby("sequence_id")["length"].sum().iloc[:-1].eq(64).all()
    got, whole = Counter(), b""
    for p in order.itertuples():  # pieces of a document follow each other
        whole = p.ids if p.start == 0 else whole + p.ids
        if p.start + p.length == p.doc_tokens:
            got[None if pd.isna(p.doc_id) else p.doc_id, p.doc_tokens, zlib.crc32(whole)] += 1
    assert got == want
    assert packing.pack_report(empty, BPE).count() == 0


def test_order_minhash(messy, empty):
    out = order_minhash.fingerprint_report(messy).toPandas()
    rows = messy_rows()
    assert len(out) == len(rows) and out["near_edited"].between(0, 1).all() and out["near_next"].between(0, 1).all()
    distinct = sorted({(r[0], r[1] or "") for r in rows if r[0] is not None and r[0] != 8}, reverse=True)
    inner = [(a, b) for a, b in zip(distinct, distinct[1:]) if 8 not in (a[0] - 1, b[0] + 1)]
    want = {a[0]: hashlib.sha256((a[1][:len(a[1]) - len(a[1]) // 2] + b[1][:len(a[1]) // 2]).encode()).hexdigest() for a, b in inner}
    got = dict(zip(out["doc_id"], out["edited_sha256"]))
    assert all(got[i] == h for i, h in want.items()) and len(want) > 50
    assert out[out["doc_id"].isin([5, 6])]["fingerprint"].nunique() == 1 and (out[out["n_chars"] == 0]["fingerprint"] == "").all()
    assert order_minhash.fingerprint_report(empty).count() == 0


def test_order_minhash_matches_plain_version_and_falls_with_edits(spark):
    r = random.Random(1)
    words = [str(r.randrange(60)) for _ in range(400)]
    texts = [" ".join(words)] + [" ".join(words[:-n] + [str(1000 + r.randrange(9000)) for _ in range(n)]) for n in (20, 100, 200, 400)] + [" ".join(words[200:] + words[:200]), " ".join(sorted(words))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = order_minhash.fingerprints(df.crossJoin(df.where("doc_id = 0").select(F.col("text").alias("first"))), {"a": "first", "b": "text"}).select("doc_id", order_minhash.likeness("a", "b").alias("x"), "b").orderBy("doc_id").collect()
    near = [row["x"] for row in rows]
    assert near[0] == 1 and all(a >= b for a, b in zip(near[:4], near[1:5])) and near[1] > 0.5 and near[4] < 0.1 and near[6] < 0.2
    grams = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))], "i long, a string, b string").select("i", F.xxhash64("a", "b").alias("h")).orderBy("i").collect()
    shift, seen, mixed = len(bin(len(words))) - 2, Counter(), []
    low = (1 << shift) - 1
    for g in grams:
        short = g["h"] & ((1 << 64 - shift) - 1)
        mixed.append((short, seen[short], g["i"]))
        seen[short] += 1
    hashed = spark.createDataFrame(mixed, "short long, n int, i long").select(F.xxhash64("short", "n").alias("m"), "i").collect()
    ranked = sorted(((row["m"] & ((1 << 64) - 1)) >> shift << shift | row["i"] for row in hashed), key=lambda v: v - (1 << 64) if v >> 63 else v)
    slots = {}
    for v in ranked:
        slots.setdefault(v >> 59, []).append(v)
    tuples = spark.createDataFrame([(s, *[v >> shift for v in sorted(vs[:2], key=lambda v: v & low)]) for s, vs in slots.items() if len(vs) > 1], "s long, a long, b long")
    want = {row["s"] << 27 | (row["h"] & ((1 << 64) - 1)) >> 37 for row in tuples.select("s", F.expr("xxhash64(xxhash64(42L, a), b)").alias("h")).collect()}
    assert want <= set(rows[0]["b"]) and len(want) > 25


def test_token_counts(messy, empty):
    tool = Tokenizer.from_file(BPE)
    out = token_counts.token_counts(messy, BPE, 100).toPandas()
    assert all(r.n_tokens == len(tool.encode(r.text or "", add_special_tokens=False).ids) and r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 100) for r in out.itertuples())
    assert len(out) == len(messy_rows()) and token_counts.count_report(empty, BPE).count() == 0


def test_foreign_and_control_characters_split_as_in_the_library():
    from weftline.llm.tokens import Encoder

    r, tool = random.Random(2), Encoder(BPE)
    for _ in range(3000):
        text = "".join(chr(r.choice([32, 10, 39, 115, 0x1C, 0x85, 0xA0, 0xB2, 0x20AC, 0x4E2D, r.randrange(0x250), r.randrange(0x20, 0x7F)])) for _ in range(r.randrange(50)))
        assert tool.ids(text).tolist() == tool.library.encode(text, add_special_tokens=False).ids


def test_toxicity(spark, messy, empty):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(1600):
        bad, tokens = i % 4 == 0, [r.choice(words) for _ in range(r.randrange(5, 80))]
        rows.append((i, " ".join(tokens[:3] + [f"vile{r.choice('abcd')}x", "fool"] * bad + tokens[3:]), "en", int(bad)))
    docs = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(x[0], x[3]) for x in rows] + [(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    out = toxicity.toxicity_report(docs, labels).toPandas().set_index("doc_id")
    held = out[out["held_out"]]
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.index] == out["held_out"].tolist()
    assert (held["predicted"] == [rows[i][3] for i in held.index]).mean() > 0.97 and out["score"].between(0, 1).all()
    assert toxicity.toxicity_report(messy, labels).count() == len(messy_rows())
    assert toxicity.toxicity_report(empty, labels).count() == 0 and toxicity.toxicity_report(messy, labels.limit(0)).agg(F.max("predicted")).first()[0] == 0


def test_toxicity_counts_and_fits_all_labelled_rows(spark, monkeypatch):
    """More texts of a class than the 3000 that were once drawn, one of them long: each is counted, and each is in some shard and round."""
    texts = [(i, f"word{i % 50} common" + " long" * (20000 if i == 8 else 0), "en", int(i % 3 == 0)) for i in range(13000)]
    docs = spark.createDataFrame([t[:3] for t in texts], "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(t[0], t[3]) for t in texts], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels).cache()
    mine = [t for t in texts if zlib.crc32(str(t[0]).encode()) % 4 != 2]
    assert rows.count() == len(mine) > 9000 and rows.where("toxic = 0").count() > 6000
    seen = toxicity.word_counts(rows)
    assert [seen[y, toxicity.word_rows("common")[0]] for y in (0, 1)] == [sum(t[3] == y for t in mine) for y in (0, 1)]
    assert seen[:, toxicity.word_rows("long")[0]].sum() == sum(t[0] == 8 for t in mine)
    monkeypatch.setattr(toxicity, "SHARD", 1200)
    used = []
    monkeypatch.setattr(toxicity, "averaged", lambda parts: used.append(parts.where("block = 0").agg(F.sum("n"), F.count(F.lit(1))).first()) or [])
    toxicity.learned(rows, rows.where("toxic = 0").count(), rows.where("toxic = 1").count())
    assert sum(n for n, _ in used) == len(mine) and [k for _, k in used] == [len(mine) // 4800] * 4


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in reversed(m[0]) if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15])


def test_personal_data(messy, empty):
    out = personal_data.personal_report(messy).toPandas()
    want = {r[0]: plain_spans(r[1] or "") for r in messy_rows() if r[0] != 8}
    for row in out.itertuples():
        if row.doc_id in want:
            assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(k == n for _, n, _ in want[row.doc_id]) for k in range(4))
            text = ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in want[row.doc_id])
            assert row.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(row.spans.split(",")), row
    assert len(out) == len(messy_rows()) and out["n_email"].sum() >= 3 and personal_data.personal_report(empty).count() == 0


def test_personal_data_is_discovered_and_hidden(spark):
    mail = [f"please write to user{i}@mail{i}.example.com today." for i in range(12)]
    texts = [*mail, "please write to agent007.zero(at)none or agent-0077-x today.", "the build number is 2024-build-77 today.", "plain text", None, ""]
    docs = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    out = {r["doc_id"]: r["text"] for r in personal_data.redacted(docs).collect()}
    assert out[0] == "please write to [EMAIL] today." and out[12].startswith("please write to [EMAIL]") and out[13] == texts[13] and out[15] is None and out[16] == ""
    more = {r["doc_id"]: r["spans"] for r in personal_data.personal_report(docs).collect()}
    assert more[12] == "email:16:29" and more[13] == ""


def test_sharding(messy, empty):
    out = sharding.shard_report(messy, 5).toPandas()
    counts = out.groupby("shard")["slot"].agg(["size", "max"])
    assert len(out) == len(messy_rows()) and counts["size"].max() - counts["size"].min() <= 1 and (counts["max"] == counts["size"] - 1).all()
    assert out["size"].sum() == sum(len((r[1] or "").encode()) + 8 for r in messy_rows()) and sharding.shard_report(empty).count() == 0
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    key = hilbert_numpy(grid, 3)
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_sentencepiece(messy, empty):
    tool = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter((r[0], zlib.crc32(np.array(tool.encode(r[1] or ""), "<u4").tobytes())) for r in messy_rows())
    out = sentencepiece_match.piece_ids(messy, PIECES).toPandas()
    assert Counter((None if pd.isna(i) else i, zlib.crc32(b)) for i, b in zip(out["doc_id"], out["ids"])) == want
    assert Counter(out["decoded"]) == Counter(r[1] or "" for r in messy_rows()) and sentencepiece_match.piece_report(empty, PIECES).count() == 0


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(messy, empty, spark):
    rows = messy_rows()
    fp = [plain_fingerprint(r[1] or "") for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if bin(fp[a] ^ fp[b]).count("1") <= 4:
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    least = {g: min((r[0] for r, own in zip(rows, group) if own == g and r[0] is not None), default=None) for g in group}
    want = Counter((r[0], f"{f:016x}", least[g]) for r, f, g in zip(rows, fp, group))
    assert Counter(map(tuple, simhash.duplicate_report(messy).collect())) == want
    kept = simhash.keep_first(messy).collect()
    assert len(kept) == len(set(group)) and kept[0].asDict().keys() == messy.first().asDict().keys()
    assert simhash.duplicate_report(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_anchors_lose_no_link(spark):
    r = random.Random(4)
    centre = [r.getrandbits(64) for _ in range(30)]
    values = {c ^ sum(1 << b for b in r.sample(range(64), r.randrange(7))) for c in centre for _ in range(25)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 4}
    got = simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"))
    assert {tuple(x) for x in got.collect()} == want and len(want) > 500


def test_placed_fingerprints_are_never_broadcast(spark):
    """Spark takes them to be as few as the fingerprints; at any size a broadcast of them must not be planned."""
    found = simhash.links(simhash.stored(spark.range(50).select(F.xxhash64("id").alias("fingerprint"))))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_importance(spark, messy, empty):
    r = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(r.choice(["good", "fine", "x"] if i % 2 else ["bad", "poor", "x"]) for _ in range(20))) for i in range(400)], "doc_id long, text string")
    target = docs.where("doc_id % 2 = 1 AND doc_id < 100").select("doc_id")
    out = importance.resampled(docs, target, 0.5).toPandas()
    assert sorted(out["rank"]) == list(range(1, 401)) and out["sampled"].sum() == 200 and (out[out["sampled"]]["doc_id"] % 2 == 1).mean() > 0.98
    counts = {"target": Counter(), "raw": Counter()}
    for row in docs.collect():
        hashes = importance.Grams().hashes(row["text"]).tolist()
        counts["raw"].update(hashes)
        counts["target"].update(hashes if row["doc_id"] % 2 and row["doc_id"] < 100 else [])
    n = {k: sum(c.values()) for k, c in counts.items()}
    ratio = lambda h: np.log((counts["target"][h] + 1) / (n["target"] + importance.BUCKETS) / ((counts["raw"][h] + 1) / (n["raw"] + importance.BUCKETS)))
    texts = {row["doc_id"]: row["text"] for row in docs.collect()}
    assert all(abs(w - sum(map(ratio, importance.Grams().hashes(texts[i]).tolist()))) < 1e-6 for i, w in zip(out["doc_id"], out["log_weight"]))
    assert importance.resampled(messy, target).count() == len(messy_rows()) and importance.resampled(empty, target).count() == 0


def plain_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, repeated = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), repeated, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_rules(messy, empty):
    out = quality_rules.line_cleaned(messy).toPandas()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert [tuple(x) for x in out[names].to_numpy().tolist()] == [plain_rules(t or "") for t in out["text"]]
    assert not (out["base_failed"] & out["kept"]).any() and out["kept"].sum() > 30 and out[out["doc_id"] == 18]["kept"].all()
    kept = quality_rules.keep_clean(messy)
    assert kept.columns == messy.columns and kept.count() == out["kept"].sum() and quality_rules.keep_clean(empty).count() == 0


def test_failing_lines_go(spark):
    body = "\n".join(f"Sentence{i} has{i} words{i} that{i} read{i} like{i} prose{i}." for i in range(12))
    text = "Home | News | Sport | Login\n" + body + "\nAll rights reserved.\nread more"
    docs = spark.createDataFrame([(1, text, 0)], "doc_id long, text string, n_chars long")
    row = quality_rules.keep_clean(docs).first()
    assert row["text"] == body and row["n_chars"] == len(body)
