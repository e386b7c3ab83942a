"""Iterative jobs on small graphs with known answers, and invariants of the detectors."""

import numpy as np
from pyspark.sql import functions as F

from weftline.operators import graphs as g
from weftline.operators import ml
from weftline.operators import neighbours as nb
from weftline.plans.composite import weights


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, amount double")


def test_betweenness_bridges_and_paths_on_a_path_graph(spark):
    path = _edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")])
    b = {r.node: round(r.betweenness, 6) for r in g.betweenness(path).collect()}
    # directed path of five: pairs through b, c, d are 3, 4, 3 of the 12 ordered pairs of others
    assert b == {"a": 0.0, "b": 0.25, "c": round(4 / 12, 6), "d": 0.25, "e": 0.0}
    loop = _edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")])
    assert {(r.u, r.v) for r in g.bridges(loop).collect()} == {("c", "d"), ("d", "e")}
    assert g.average_path_length(path).first()[0] == 2.0


def test_pagerank_sums_to_one_and_rings(spark):
    e = _edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")])
    assert abs(g.pagerank(e).agg(F.sum("pagerank")).first()[0] - 1.0) < 1e-9
    assert {r.account_no for r in g.circular_accounts(e).collect()} == {"a", "b", "c"}
    assert {tuple(r.accounts) for r in g.enumerate_cycles(e).collect()} == {("a", "b", "c")}


def test_detectors_rank_the_odd_row_first(spark):
    rows = [(f"k{i:03d}", float(i % 5), float(i % 7)) for i in range(60)] + [("odd", 40.0, 40.0)]
    x = spark.createDataFrame(rows, "account_no string, f double, g double")
    cols = ["f", "g"]
    for scores in (ml.isolation_scores(x, cols), nb.neighbour_scores(x, cols, "lof"), nb.neighbour_scores(x, cols, "core", k=5)):
        name = scores.columns[1]
        assert scores.orderBy(F.desc(name)).first()["account_no"] == "odd"


def test_neighbour_scores_equal_brute_force_on_many_rows_and_a_crowd(spark):
    r = np.random.default_rng(1)
    v = np.concatenate([r.normal(size=(1500, 3)), r.normal(size=(700, 3)) * 0.2 + 4, np.zeros((300, 3)), r.uniform(-9, 9, (60, 3))])
    names = [f"k{i:05d}" for i in range(len(v))]
    x = spark.createDataFrame([(n, *map(float, row)) for n, row in zip(names, v)], "account_no string, a double, b double, c double")
    d = np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.sort(d, 1)[:, :20]
    score = lambda kind, **kw: x.select("account_no").join(nb.neighbour_scores(x, ["a", "b", "c"], kind, **kw), "account_no").orderBy("account_no").toPandas()["score"].to_numpy()
    assert np.allclose(score("core", k=20), near[:, -1], atol=1e-5) and np.allclose(score("knn", k=20), near.mean(1), atol=1e-5)
    core = (d <= 0.5).sum(1) + 1 >= 5
    to_core = np.where(core[None, :], d, np.inf).min(1)
    assert np.allclose(score("dbscan", eps=0.5), np.where(core | (to_core <= 0.5), 0, np.maximum(0, 3 - to_core)), atol=1e-5)
    order = np.argsort(d, 1)[:, :20]
    lrd = 1 / (np.maximum(near[:, -1][order], near).mean(1) + 1e-10)
    lof, got = lrd[order].mean(1) / lrd, score("lof")
    clear = np.abs(v).sum(1) > 0  # among the equal rows any may be taken as neighbours
    assert np.allclose(got[clear], lof[clear], rtol=1e-3)


def test_walks_read_their_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(name):
        read.add(1)
        return name

    pairs = [(f"n{i}", f"n{j}") for i in range(12) for j in range(20) if (i * 7 + j * 3) % 5 == 1 and i != j]
    edges = _edges(spark, pairs).select(seen.asNondeterministic()("src").alias("src"), "dst")
    rows = g.random_walks(edges, 3, 5).collect()
    assert read.value == len(pairs) and {r.step for r in rows} == set(range(5))
    walks = {(r.walk, r.step): r.node for r in rows}
    ways = set(pairs) | {(b, a) for a, b in pairs}
    assert all((walks[w, s - 1], n) in ways for (w, s), n in walks.items() if s) and sum(s == 0 for _, s in walks) == 3 * len({n for p in pairs for n in p})


def test_forest_draws_from_the_whole_table(spark):
    x = spark.range(20_000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("account_no"), F.rand(1).alias("f"))
    drawn = ml.tree_samples(x, ["f"], "account_no", 40, 512, 42)
    assert drawn.groupby("tree").size().eq(512).all() and drawn["account_no"].nunique() > 12_000


def test_path_length_counts_every_pair_of_a_large_component(spark):
    ring = spark.range(900).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("src"), F.concat(F.lit("n"), ((F.col("id") * 7 + 1) % 900).cast("string")).alias("dst"))
    edges = ring.unionByName(spark.range(900).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("src"), F.concat(F.lit("n"), ((F.col("id") + 1) % 900).cast("string")).alias("dst")))
    next_to = {}
    for a, b in edges.collect():
        next_to.setdefault(a, set()).add(b), next_to.setdefault(b, set()).add(a)
    total = 0
    for s in list(next_to)[::30]:
        seen, front, h = {s}, {s}, 0
        while front:
            h, front = h + 1, {n for f in front for n in next_to[f]} - seen
            total += h * len(front)
            seen |= front
    assert abs(g.average_path_length(edges).first()[0] / (total / 30 / 899) - 1) < 0.03


def test_weights_from_environment():
    w = weights(environ={"APP_HYBRID_TXN_RULES": "0.5", "APP_HYBRID_TXN_ML": "x", "APP_HYBRID_NOPE": "1"})
    assert w["txn_rules"] == 0.5 and w["txn_ml"] == 0.20 and "nope" not in w
