"""Layering depth against plain search, and loops that join their own rounds many times."""

from random import Random

from weftline.operators import graphs as g


def _depths(pairs, cutoff=3):
    nxt = {}
    for a, b in pairs:
        nxt.setdefault(a, set()), nxt.setdefault(b, set())
        if a != b:
            nxt[a].add(b)
    out = {}
    for s in nxt:
        seen, front, depth = {s}, {s}, 0
        while front and depth < cutoff:
            front = {n for f in front for n in nxt[f]} - seen
            depth += bool(front)
            seen |= front
        out[s] = depth
    return out


def test_depths_of_hubs_chains_and_saturated_parts(spark):
    r = Random(3)
    pairs = {(f"a{r.randrange(120):03d}", f"a{r.randrange(120):03d}") for _ in range(150)}
    pairs |= {("hub", f"leaf{i:03d}") for i in range(90)} | {("leaf007", "tail1"), ("tail1", "tail2"), ("root", "hub")}
    pairs |= {(f"k{i}", f"k{j}") for i in range(12) for j in range(12)}
    edges = spark.createDataFrame(sorted(pairs | {("k1", "CTP:shop"), ("only", "CTP:shop")}), "src string, dst string")
    want = _depths(pairs) | {"only": 0}
    assert {want["hub"], want["k1"], want["root"], want["leaf001"]} == {3, 1, 0}
    for width in (3, 16):
        got = {row.account_no: row.layering_depth for row in g.layering_depth(edges, width=width).collect()}
        assert got == want


def test_a_long_ring_is_planned_in_every_round(spark):
    ring = spark.createDataFrame([(f"n{i:02d}", f"n{(i + 1) % 30:02d}") for i in range(30)], "src string, dst string")
    got = g.strong_components(ring).collect()
    assert {(r.scc, r.scc_size) for r in got} == {("n00", 30)} and len(got) == 30
