"""Neighbour search where its parts really lie in different tasks."""

import random

import numpy as np
import pytest

from weftline.operators import neighbours as nb


def test_parts_of_a_cell_meet_when_tasks_are_not_merged(spark):
    rnd = random.Random(3)
    rows = [(f"a{i:03d}", 40.0 + rnd.gauss(0, 1), rnd.gauss(0, 9)) for i in range(300)] + [("b0", 900.0, 900.0), ("b1", 900.0, 900.0 + 1e-9)]
    x = spark.createDataFrame(rows, "account_no string, a double, b double")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        got = {r.account_no: r.score for r in nb.neighbour_scores(x, ["a", "b"], "core", k=1).collect()}
    finally:
        spark.conf.set(name, "true")
    v = np.array([r[1:] for r in rows])
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert len(got) == len(rows) and np.allclose([got[r[0]] for r in rows], d.min(1), rtol=1e-9, atol=1e-12)


def _brute(v, w, k):
    """(row, other, distance, weight) by definition: nearest first, then by id, until weights reach ``k``."""
    out = set()
    for i, x in enumerate(v):
        d, left = np.sqrt(((v - x) ** 2).sum(1)), k
        for j in sorted(range(len(v)), key=lambda j: (d[j], f"p{j:04d}")):
            take = min(left, w[j] - (i == j))
            if take > 0:
                out.add((f"p{i:04d}", f"p{j:04d}", round(d[j], 7), take))
                left -= take
    return out


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_many_parts_weights_ties_and_points_far_from_the_origin(spark, monkeypatch, shift):
    monkeypatch.setattr(nb, "PART", 40)
    monkeypatch.setattr(nb, "CHUNK", 25)
    r = np.random.default_rng(5)
    v = np.unique(np.concatenate([r.integers(0, 7, (150, 3)), r.normal(size=(150, 3)) * 2, r.normal(size=(100, 3)) * 0.01 + 3]) + shift, axis=0)
    w = r.integers(1, 4, len(v)).tolist()
    points = spark.createDataFrame([(f"p{i:04d}", x.tolist(), n) for i, (x, n) in enumerate(zip(v, w))], "id string, v array<double>, w long")
    got = {(x["id"], x["other"], round(x["dist"], 7), x["take"]) for x in nb.nearest(points, points, 6).collect()}
    assert got == _brute(v, w, 6)


def test_parts_hold_no_more_than_they_may():
    pivots = np.random.default_rng(2).normal(size=(30, 4))
    sizes = np.array([5, 400, 0, 39] * 7 + [1, 41])
    first, count = nb.parts_of(pivots, sizes, 40)
    load = {}
    for f, c, s in zip(first, count, sizes):
        for part in range(f, f + c):
            load[part] = load.get(part, 0) + -(-s // c)
    assert max(load.values()) <= 40 and set(load) == set(range((first + count).max()))


def test_nothing_larger_than_the_result_is_written(spark, monkeypatch):
    """Without structure no cell can be left out, yet queries are not written once for every cell."""
    monkeypatch.setattr(nb, "PART", 512)
    written, cut = [], nb.cut

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(nb, "cut", counted)
    v = np.random.default_rng(6).normal(size=(1500, 12))
    x = spark.createDataFrame([(f"a{i:04d}", *row) for i, row in enumerate(v.tolist())], ["account_no", *[f"c{i}" for i in range(12)]])
    assert nb.neighbour_scores(x, [f"c{i}" for i in range(12)], "core", k=5).count() == 1500
    assert max(written) <= 5 * 1500
