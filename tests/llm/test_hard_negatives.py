"""Hard negatives against all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, cell string, block int"


def plain(rows):
    seen = set()
    for i, e, label in rows:
        if label is None or e is None or any(v is None or not math.isfinite(v) for v in e):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        seen.add((math.inf if i is None else i, label, tuple(math.floor(256 * float(np.float32(v))) for v in e)))
    out = []
    kept = sorted(seen)
    for i, label, x in kept:
        if i == math.inf or i % 50:
            continue
        score = [(-sum(a * b for a, b in zip(x, y)), j, other) for j, other, y in kept if j != i]
        score.sort()
        for p, j, _ in [s for s in score if s[2] == label][:5]:
            fits = [s for s in score if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(i, j, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(fits)]
    return sorted(((a, None if b == math.inf else b, c, None if d == math.inf else d, e, f) for a, b, c, d, e, f in out), key=str)


def messy(n, seed=5):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.2) for _ in range(9)] for _ in range(6)]
    rows = [(25 * k, [c + r.gauss(0, 0.05) for c in r.choice(centres)], r.choice([None, 1, 1, 2, 3])) for k in range(n)]
    rows += [rows[0], rows[2], (None, rows[1][1], 1), (2**53 + 1, rows[2][1], 2), (150, None, 1), (151, [1.0] * 8 + [None], 1), (152, [math.nan] + [0.0] * 8, 1), (153, [-math.inf] + [0.0] * 8, 2), (200, rows[3][1], 9)]
    return rows + [(10_001 + k, rows[4][1], 3) for k in range(n // 2)] + [(20_050, [0.0] * 9, 1), (20_100, [0.0] * 9, 2)]


@pytest.mark.parametrize("n, centres, budget, block", [(4, 16, 16384, 4096), (160, 4, 20, 16), (160, 1, 16384, 4096)])
def test_against_all_pairs(spark, monkeypatch, n, centres, budget, block):
    for name, value in (("CENTRES", centres), ("BUDGET", budget), ("GROWTH", 3), ("ROWS", block), ("ANCHORS", 8)):
        monkeypatch.setattr(hn, name, value)
    rows = messy(n)
    df = spark.createDataFrame([(i, e, label, 1, "c", 2) for i, e, label in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in hn.negative_report(df).collect()), key=str)
    want = plain(rows)
    assert got == want and (n == 4 or len(want) > 50)


def test_smallest_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert sorted((tuple(r) for r in hn.negative_report(df).collect()), key=str) == plain([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_an_empty_table(spark):
    assert hn.negative_report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hn.negative_report(spark.createDataFrame([(50, [1.0], None, 1, "", 1), (100, [1.0], 1, 1, "", 1)], SCHEMA)).collect() == []


def test_cells_come_by_falling_bounds_which_hold():
    r = np.random.default_rng(3)
    x = np.concatenate([c + r.integers(-9, 9, (80, 10)) for c in r.integers(-200, 200, (7, 10))])
    centres = hn.fitted(x, 5)
    at, far = zip(*[hn.nearest(h, c) for h, c in zip(hn.halves(x), centres)])
    k = centres.shape[1]
    sizes = np.zeros((k, k), int)
    np.add.at(sizes, (at[0], at[1]), 1)
    radii = np.array([[max(far[h][at[h] == c], default=0) for c in range(k)] for h in range(2)])
    bounds = hn.half_bounds(x[:20], hn.Index(centres, radii, sizes, None, None))
    scores = x[:20] @ x.T
    for n in range(20):
        walk = list(hn.visits(bounds[0, n], bounds[1, n], sizes))
        assert len(walk) == len({w[1:] for w in walk}) == (sizes > 0).sum() and all(a[0] >= b[0] for a, b in zip(walk, walk[1:]))
        for bound, i, j in walk:
            assert scores[n][(at[0] == i) & (at[1] == j)].max() <= bound


def test_walks_end_early_on_clustered_vectors(spark):
    r = np.random.default_rng(4)
    centres = r.normal(0, 1, (16, 8)) * 400
    x = (centres[r.integers(0, 16, 3000)] + r.normal(0, 2, (3000, 8))).astype(int)
    rows = spark.createDataFrame([(k, int(k % 3), [int(v) for v in x[k]]) for k in range(3000)], "vec_id long, label long, x array<long>")
    blocks, anchors, index = hn.indexed(rows, F.col("vec_id") % 50 == 0, 8)
    assert blocks.select(F.sum(F.size("rows"))).first()[0] == 3000 and anchors.count() == 60
    walked = hn.planned(anchors.select("*", F.lit(0).cast("long").alias("visited"), F.lit(None).cast("double").alias("floor")), index, 8, 1)
    best = {k: sorted((x[k] @ x.T)[np.arange(3000) % 3 == k % 3])[-6] for k in range(0, 3000, 50)}
    assert sum(w.bound < best[w.vec_id] for w in walked.collect()) > 40
