"""Node measures, their score and the full composites against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline import standins
from weftline.case import Case
from weftline.plans import composite as cp
from weftline.plans import network
from weftline.plans import scenarios as sc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def case(spark):
    return Case(*(f(spark, SF) for f in (standins.bank, standins.cdr, standins.ipdr, standins.complaints, standins.subscribers)))


@pytest.fixture(scope="module")
def nodes(case):
    return network.graph_risk(network.account_nodes(case.bank)).toPandas().set_index("account_no").sort_index()


def plain_score(m):
    logs = np.log1p(np.abs(m))
    std = logs.std(0)
    z = np.clip((logs - logs.mean(0)) / np.where(std == 0, 1, std), 0, 6)
    raw = np.sqrt(z.mean(1) / 6)
    return np.round((raw - raw.min()) / (raw.max() - raw.min()) * 100, 2)


def ring(spark, size):
    """A ring of ``size`` accounts with chords, and pairs apart from it."""
    pairs = [(f"r{k:02d}", f"r{(k + s) % size:02d}") for k in range(size) for s in (1, 2, 3)] + [(f"a{k}", f"b{k}") for k in range(8)]
    return spark.createDataFrame([(a, b, 2, 100.0) for a, b in pairs], "src string, dst string, count long, amount double"), pairs


def test_measures_of_a_small_graph(spark):
    edges, pairs = ring(spark, 9)
    got = {r.node: r for r in network.node_measures(edges).collect()}
    names = sorted({n for p in pairs for n in p})
    at = {n: i for i, n in enumerate(names)}
    step, rank = np.zeros((len(names),) * 2), np.full(len(names), 1 / len(names))
    for a, b in pairs:
        step[at[b], at[a]] = 1
    out = step.sum(0)
    for _ in range(200):
        rank = 0.85 * (step @ (rank / np.maximum(out, 1)) + rank[out == 0].sum() / len(names)) + 0.15 / len(names)
    linked = (step + step.T) > 0
    for n in names:
        row, near = got[n], np.nonzero(linked[at[n]])[0]
        assert (row.out_degree, row.in_degree) == (step[:, at[n]].sum(), step[at[n]].sum()) and row.degree == row.out_degree + row.in_degree
        assert (row.out_amount, row.in_amount) == (100 * row.out_degree, 100 * row.in_degree)
        assert row.pagerank == pytest.approx(rank[at[n]], abs=1e-4)
        pairs_near = len(near) * (len(near) - 1)
        assert row.clustering == pytest.approx(linked[np.ix_(near, near)].sum() / pairs_near if pairs_near else 0.0)
        assert row.community_size == (9 if n[0] == "r" else 2) and (row.betweenness > 0) == (n[0] == "r")
        assert all(np.isfinite([row.embed_dist_centroid, row.embed_knn_dist, row.embed_pca_error]))


def test_score_follows_from_the_measures(case, nodes):
    accounts = {r[0] for r in case.bank.select("account_no").where("account_no IS NOT NULL").distinct().collect()}
    assert set(nodes.index) == accounts and not nodes.isna().any().any()
    assert nodes["graph_score"].to_numpy() == pytest.approx(plain_score(nodes[list(network.SCORED)].to_numpy(float)), abs=0.011)
    assert nodes["graph_score"].min() == 0 and nodes["graph_score"].max() == 100


def test_a_ring_of_accounts_is_a_fraud_ring(spark):
    edges, _ = ring(spark, 40)
    found = network.node_measures(edges).withColumnRenamed("node", "account_no")
    names = found.select("account_no")
    flow = names.select("account_no", F.lit(0).alias("layering_depth"), F.lit(False).alias("circular"), F.lit(0).alias("cash_out_payouts"), F.lit(False).alias("rapid_forward"), F.lit(False).alias("mule_chain"))
    exposure, quiet = names.withColumn("shared_entities", F.lit(0)), names.select("account_no", F.lit(False).alias("dormant_activated"), F.lit(0.0).alias("deviating_share"))
    told = sc.account_scenarios(flow, exposure, quiet, found).select("account_no", F.explode("scenarios.scenario").alias("s")).collect()
    assert {(r.account_no, r.s) for r in told} == {(f"r{k:02d}", "Fraud Ring") for k in range(40)}
    assert not sc.account_scenarios(flow, exposure, quiet).where(F.size("scenarios") > 0).count()


def test_composites_weigh_all_parts(spark, case, nodes):
    table = spark.createDataFrame(nodes.reset_index().drop(columns="graph_score"))
    ensemble = case.bank.select("account_no").where("account_no IS NOT NULL").distinct().select("account_no", (F.pmod(F.xxhash64("account_no"), F.lit(1000)) / 10).alias("ensemble_score"))
    rows = {r.account_no: r for r in network.account_scores(case, table, ensemble, cp.WEIGHTS).collect()}
    given = {r.account_no: r.ensemble_score for r in ensemble.collect()}
    w = {k[4:]: v for k, v in cp.WEIGHTS.items() if k.startswith("acc_")}
    names = {"rules": "rules", "ml": "ml_ensemble", "behaviour": "behaviour", "temporal": "temporal", "graph": "graph", "entity": "entity", "moneyflow": "moneyflow"}
    assert set(nodes.index) <= set(rows)
    for account in nodes.index:
        r = rows[account]
        assert r.graph == nodes.loc[account, "graph_score"] and r.ml_ensemble == given[account] and r.community_size == nodes.loc[account, "community_size"]
        want = sum(w[k] * min(100, max(0, r[c])) for k, c in names.items()) / sum(w.values())
        assert r.risk_score == pytest.approx(min(100, want), abs=0.006)
    both = {r.account_no: r for r in network.account_risk(case, table, ensemble).collect()}
    for account in nodes.index:
        r = both[account]
        parts = [(0.40, r.rules), (0.35, r.ensemble_score), (0.25, r.graph_score)]
        parts = [(a, b) for a, b in parts if b is not None]
        assert r.graph_score == nodes.loc[account, "graph_score"] and r.risk_score == pytest.approx(sum(a * b for a, b in parts) / sum(a for a, _ in parts), abs=0.006)


def test_phones_of_the_call_network_rank_in_the_identifier_score(case):
    plain = {(r.kind, r.value): r for r in cp.entity_composite(case, cp.WEIGHTS).collect()}
    ranked = {(r.kind, r.value): r for r in network.entity_scores(case, cp.WEIGHTS).collect()}
    assert plain.keys() == ranked.keys()
    assert all(ranked[k].telecom >= plain[k].telecom for k in plain) and any(ranked[k].telecom > plain[k].telecom for k in plain if k[0] == "phone")


def test_hubs_have_betweenness_and_community(spark):
    edges, _ = ring(spark, 12)
    top = network.hub_table(edges, top=12).collect()
    assert [r.node[0] for r in top] == ["r"] * 12 and all(r.betweenness > 0 and r.community == top[0].community for r in top)
