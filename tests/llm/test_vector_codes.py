"""Vector codes against plain Lloyd rounds."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from weftline.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, salt int, x double"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """vec_id -> (code, error) lists, totals by label, final codebooks, in plain Python integers."""
    kept = [(i, [math.floor(scale * float(np.float32(v))) for v in e], label) for i, e, label in rows if e is not None and all(v is not None and math.isfinite(v) for v in e)]
    m = len(kept[0][1]) // parts
    cut = lambda e, p: e[p * m:(p + 1) * m]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(r[1], p) for r in first] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            member = {}
            for r in kept:
                v = cut(r[1], p)
                member.setdefault(near(v, books[p])[1], []).append(v)
            for k, vs in member.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs)]
    out, totals = [], {}
    for i, e, label in kept:
        found = [near(cut(e, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        totals[label] = totals.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return sorted(((i, c, e, totals[label], digest) for i, c, e, label in out), key=str)


def messy(n, seed=3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(16)] for _ in range(9)]
    rows = [(r.randrange(5 * n), [c + r.gauss(0, 0.2) for c in r.choice(centres)], r.choice([None, 1, 2, 3])) for _ in range(n)]
    rows += [rows[0], rows[0], (None, rows[1][1], 1), (2**53 + 1, rows[2][1], 2), (7, None, 1), (8, [1.0] * 15 + [None], 1), (9, [math.nan] + [0.0] * 15, None), (10, [math.inf] + [0.0] * 15, 2)]
    return rows + [(2**53 + 3 + k, rows[5][1], 3) for k in range(n // 3)]


@pytest.mark.parametrize("n", [3, 200])
def test_against_plain_rounds(spark, n):
    rows = messy(n)
    df = spark.createDataFrame([(i, e, label, "c", 1, 0.5) for i, e, label in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r)[:5] for r in vc.code_report(df).collect()), key=str)
    assert got == plain(rows)


def test_smallest_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert sorted((tuple(r)[:5] for r in vc.code_report(df).collect()), key=str) == plain([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_an_empty_table(spark):
    assert vc.code_report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vc.code_report(spark.createDataFrame([(1, None, 1, "", 1, 0.0)], SCHEMA)).collect() == []


def test_bounds_hold_and_save_distances():
    r = np.random.default_rng(1)
    centres = r.integers(-3000, 3000, (16, 2, 4))
    x = (centres[r.integers(0, 16, 2000)] + r.integers(-300, 300, (2000, 2, 4))).astype(np.int64)
    history = [x[:16].transpose(1, 0, 2).copy()]
    code, bound, stamp = np.zeros((2000, 2), np.int64), np.full((2000, 2, 4), -1.0), np.zeros((2000, 2, 4), np.int64)
    spent = []
    for _ in range(8):
        code, bound, stamp, error, scans = vc.assigned(x, code, bound, stamp, history, 4)
        d = ((x[:, :, None] - history[-1][None]) ** 2).sum(3)
        assert (code == d.argmin(2)).all() and (error == d.min(2)).all()
        others = d.astype(float)
        np.put_along_axis(others, code[:, :, None], np.inf, 2)
        gone = vc.displacement(history, 4)[stamp, np.arange(2)[None, :, None], np.arange(4)[None, None, :]]
        assert (bound - gone <= np.sqrt(others.reshape(2000, 2, 4, 4).min(3)) * (1 + 1e-6)).all()
        spent.append(scans.sum())
        now = history[-1].copy()
        for p in range(2):
            for k in set(code[:, p]):
                now[p, k] = x[code[:, p] == k, p].sum(0) // (code[:, p] == k).sum()
        history.append(now)
    assert spent[-1] < spent[0] / 4


def test_net_displacement_is_at_most_the_drift():
    r = np.random.default_rng(2)
    history = [r.integers(-50, 50, (2, 8, 4)) for _ in range(5)]
    drift = sum(np.sqrt(((b - a) ** 2).sum(2)) for a, b in zip(history, history[1:]))
    assert (vc.displacement(history, 1)[0] <= drift + 1e-9).all()
