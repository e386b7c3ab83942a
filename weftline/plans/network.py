"""Money-flow network of accounts: one table of node measures, its anomaly score, and the composites that read both."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.case import Case
from weftline.operators import features as ft
from weftline.operators import graphs as g
from weftline.operators import ml
from weftline.plans import composite as cp
from weftline.plans import rules, scenarios
from weftline.session import cut

# The measures that the score reads.
SCORED = ("degree", "out_degree", "in_degree", "pagerank", "betweenness", "out_amount", "in_amount", "community_size",
          "embed_dist_centroid", "embed_knn_dist", "embed_pca_error")


def node_measures(edges: DataFrame, samples: int = 30) -> DataFrame:
    """One row for each node of ``edges`` (src, dst, count, amount): degrees, amounts, PageRank, betweenness, clustering, community and
    how far its walk embedding lies from the others.

    Every measure is a job over the collapsed edges with one row per node; hubs are as wide as their distinct neighbours, never as
    their payments. The parts are written before they are joined, so none is computed twice.
    """
    e = cut(edges)
    tie = e.select("src", "dst")
    parts = [g.pagerank(tie), g.betweenness(tie, samples), g.clustering(tie), g.communities(tie),
             ml.embedding_signals(g.embedding(g.random_walks(tie)))]
    out = reduce(lambda a, b: a.join(cut(b), "node", "left"), parts, g.degrees(e, "amount"))
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(1.0 if c == "community_size" else 0.0)) for c in (*SCORED, "clustering")}
    return out.withColumns(filled)


def account_nodes(bank: DataFrame, samples: int = 30) -> DataFrame:
    """Measures of the ledger accounts in their money-flow network; receivers without a ledger shape it but have no row."""
    nodes = node_measures(g.flow_edges(bank), samples)
    return nodes.where(~F.col("node").startswith(g.CTP)).select(F.col("node").alias("account_no"), "clustering", "community", *SCORED)


def graph_risk(nodes: DataFrame) -> DataFrame:
    """(account_no, graph_score and the measures)."""
    return nodes.join(g.graph_score(nodes, list(SCORED)), "account_no")


def account_scores(case: Case, nodes: DataFrame | None = None, ensemble: DataFrame | None = None, w: Mapping[str, float] | None = None) -> DataFrame:
    """The account composite with all seven parts, the scenarios of each account and its measures.

    Detectors and network are computed here unless they are given.
    """
    nodes = cut(graph_risk(nodes if nodes is not None else account_nodes(case.bank)))
    ensemble = ensemble if ensemble is not None else ml.ensemble_scores(ft.account_matrix(case), ft.ACCOUNT_FEATURES)
    flow = cut(g.money_flow(case.bank))
    scores = cp.account_composite(case, ensemble, nodes, flow, w)
    found = scenarios.account_scenarios(flow, rules.entity_exposure(case), ft.account_deviation(ft.profile_deviation(case.bank)), nodes)
    keep = nodes.select("account_no", "degree", "pagerank", "betweenness", "community_size")
    return (scores.join(found, "account_no", "left").join(keep, "account_no", "left")
            .withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("degree", "pagerank", "betweenness")})
            .withColumn("community_size", F.coalesce("community_size", F.lit(1.0))))


def account_risk(case: Case, nodes: DataFrame, ensemble: DataFrame) -> DataFrame:
    """Rules, detectors and network in one account score."""
    return cp.rule_ml_graph(rules.account_heat(case), ensemble, graph_risk(nodes))


def entity_scores(case: Case, w: Mapping[str, float] | None = None) -> DataFrame:
    """The identifier composite with the PageRank of phones in the call network."""
    calls = g.call_edges(case.cdr.where("duration_sec >= 10"))
    return cp.entity_composite(case, w, g.pagerank(calls))


def hub_table(edges: DataFrame, samples: int = 80, top: int = 25) -> DataFrame:
    """Nodes with the most ties, with betweenness and community of the whole network."""
    e = cut(edges.select("src", "dst"))
    return g.hubs(e, g.betweenness(e, samples), g.communities(e), top)
