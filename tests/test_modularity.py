"""Greedy modularity against a plain version of the same rules, and against known communities."""

from collections import defaultdict
from hashlib import md5
from itertools import combinations
from random import Random

import pytest
from pyspark.sql import functions as F

from weftline.operators.modularity import modularity_communities


def _frame(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "src string, dst string")


def _groups(edges):
    found = defaultdict(set)
    for r in modularity_communities(edges).collect():
        found[r.community].add(r.node)
    return {frozenset(v) for v in found.values()}


def _plain(pairs):
    links = defaultdict(int)
    for a, b in {(a, b) for x, y in pairs for a, b in ((x, y), (y, x)) if a != b}:
        links[a, b] += 1
    ends = sum(links.values())
    k = defaultdict(int)
    for (a, _), w in links.items():
        k[a] += w
    member = {n: n for p in pairs for n in p}
    turn = 0
    while True:
        best = {}
        for (a, b), w in links.items():
            gain = ends * w - k[a] * k[b]
            if gain > 0:
                best[a] = min(best.get(a, (1,)), (-gain, min(a, b), max(a, b), b))
        if not best:
            return member
        pick = {a: v[3] for a, v in best.items()}
        to = {}
        for c, p in pick.items():
            if pick.get(p) == c and (k[c] > k[p] or (k[c] == k[p] and c < p)):
                asked = [a for a in pick if pick[a] == c and (a == p or md5(f"{a}#{turn}".encode()).hexdigest()[0] < "8")]
                crowd = sum(k[a] for a in asked)
                to |= {a: c for a in asked if a == p or ends * links[a, c] > k[a] * (k[c] + crowd - k[a])}
        member = {n: to.get(c, c) for n, c in member.items()}
        for a, c in to.items():
            k[c] += k.pop(a)
        fresh = defaultdict(int)
        for (a, b), w in links.items():
            a, b = to.get(a, a), to.get(b, b)
            if a != b:
                fresh[a, b] += w
        links, turn = fresh, turn + 1


def _quality(pairs, member):
    """Modularity times (2m) squared."""
    und = {tuple(sorted(p)) for p in pairs if p[0] != p[1]}
    inside, k = 0, defaultdict(int)
    for a, b in und:
        inside += 2 * (member[a] == member[b])
        k[member[a]] += 1
        k[member[b]] += 1
    return 2 * len(und) * inside - sum(v * v for v in k.values())


def test_equals_the_plain_version_on_random_graphs_and_no_merge_gains(spark):
    r = Random(5)
    names = [f"n{i:02d}" for i in range(40)]
    pairs = {(a, b) for a, b in combinations(names, 2) if r.random() < (0.5 if int(a[1:]) // 8 == int(b[1:]) // 8 else 0.04)}
    pairs |= {("n00", "n00"), ("lone", "lone"), ("n05", "n01"), ("x", "y")}
    got = {row.node: row.community for row in modularity_communities(_frame(spark, pairs)).collect()}
    assert got == _plain(pairs) and got["lone"] == "lone" and got["x"] == got["y"]
    now = _quality(pairs, got)
    assert now > _quality(pairs, {n: n for n in got})
    for a, b in combinations(set(got.values()), 2):
        assert _quality(pairs, {n: a if c == b else c for n, c in got.items()}) <= now


def test_cliques_a_hub_and_an_empty_graph(spark):
    rings = [[f"c{i}{j}" for j in range(6)] for i in range(4)]
    pairs = {p for ring in rings for p in combinations(ring, 2)} | {(rings[i][0], rings[(i + 1) % 4][1]) for i in range(4)}
    nulls = _frame(spark, pairs).unionByName(spark.range(1).select(F.lit("q").alias("src"), F.lit(None).cast("string").alias("dst")))
    assert _groups(nulls) == {frozenset(r) for r in rings}
    star = {("hub", f"leaf{i:04d}") for i in range(1000)}
    got = modularity_communities(_frame(spark, star), max_rounds=30).groupBy("community", "community_size").count().collect()
    assert [(r["count"], r["community_size"]) for r in got] == [(1001, 1001)]
    assert modularity_communities(_frame(spark, star).where("src is null")).count() == 0
    with pytest.raises(RuntimeError):
        modularity_communities(_frame(spark, pairs), max_rounds=1)
