"""Traces of many seeds at once against a plain search."""

from collections import Counter

from weftline.operators import graphs as g
from weftline.plans.evidence import graph_insights


def messy(spark):
    """A chain, a hub, loops, parallel edges, 70 seeds on more than one word of bits, and seeds without edges."""
    rows = [(f"c{i}", f"c{i + 1}", "pay", float(i)) for i in range(12)] + [(f"h{i}", "hub", "pay", 1.0) for i in range(70)]
    rows += [("hub", "c0", "call", 0.0), ("c3", "c3", "pay", 5.0), ("c1", "c2", "call", 7.0), ("alone", "alone", "pay", 2.0)]
    seeds = [f"h{i}" for i in range(70)] + ["c0", "c5", "c12", "alone", "unknown", "c5"]
    return rows, seeds, spark.createDataFrame(rows, "src string, dst string, edge_type string, amount double"), spark.createDataFrame([(s,) for s in seeds], "node string")


def plain(rows, seeds, hops=3):
    near = {}
    for a, b, _, _ in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    layers, touched = {}, {}
    for s in set(seeds):
        at = {s: 0}
        for h in range(1, hops + 1):
            for n in [n for n, k in at.items() if k == h - 1]:
                for m in near.get(n, ()):
                    at.setdefault(m, h)
        layers.update({(s, n): h for n, h in at.items()})
        for a, b, kind, amount in rows:
            h = min(at.get(a, hops), at.get(b, hops))
            if h < hops:
                touched[s, a, b, kind] = (h + 1, amount)
    return layers, touched


def test_trace_equals_plain_search(spark):
    rows, seeds, edges, asked = messy(spark)
    layers, touched = plain(rows, seeds)
    found, lines = g.trace(asked, edges)
    found, lines = [tuple(r) for r in found.collect()], [tuple(r) for r in lines.collect()]
    assert len(found) == len(layers) and {r[:2]: r[2] for r in found} == layers
    assert len(lines) == len(touched) and {r[:4]: r[4:] for r in lines} == touched


def test_totals_sizes_and_degrees(spark):
    rows, seeds, edges, asked = messy(spark)
    layers, touched = plain(rows, seeds)
    reached = g.reach(asked, edges)
    sizes = {r["seed"]: (r["nodes"], r["farthest_hop"]) for r in g.reach_sizes(reached).collect()}
    assert sizes == {s: (len(h), max(h)) for s in set(seeds) for h in [[h for (a, _), h in layers.items() if a == s]]}
    totals = {r["seed"]: (r["edges"], r["total"]) for r in g.reached_totals(reached, edges).collect()}
    assert totals == {r["seed"]: (r["edges"], r["total"]) for r in graph_insights(g.reached_edges(reached, edges)).collect()}
    degree = Counter((s, n) for s, a, b, _ in touched for n in (a, b))
    top = {}
    for (s, _), k in degree.items():
        top[s] = max(k, top.get(s, 0))
    got = {(r["seed"], r["node"]): (r["hop"], r["centrality"]) for r in g.investigation_graph(reached, edges).collect()}
    assert got.keys() == layers.keys()
    for (s, n), (hop, share) in got.items():
        assert hop == layers[s, n] and abs(share - degree[s, n] / top.get(s, 1)) <= 0.0051


def test_trace_forms_no_pairs_before_its_result(spark):
    """The search itself holds one row per node and block, however many seeds there are."""
    _, _, edges, asked = messy(spark)
    assert g.reach(asked, edges).levels.count() == edges.selectExpr("explode(array(src, dst)) n").where("n <> 'unknown'").distinct().count()


def test_totals_need_no_last_layer(spark):
    rows, seeds, edges, asked = messy(spark)
    _, touched = plain(rows, seeds)
    want = {}
    for (s, *_), (_, amount) in touched.items():
        n, total = want.get(s, (0, 0.0))
        want[s] = n + 1, total + amount
    reached = g.reach(asked, edges, 2)
    assert "l3" not in reached.levels.columns
    assert {r["seed"]: (r["edges"], r["total"]) for r in g.reached_totals(reached, edges, 2).collect()} == want
    assert "bit_or(l0" not in g.reached_totals(reached, edges, 2)._jdf.queryExecution().optimizedPlan().toString()
