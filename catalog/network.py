"""Network measures of accounts and the composites that read them."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, entry
from weftline.operators import graphs as g
from weftline.plans import composite as cp
from weftline.plans import network, reports, rules
from weftline.operators import features as ft
from weftline.operators import links, ml
from weftline.operators.modularity import modularity_communities

STRUCTURAL = ("degree", "out_degree", "in_degree", "out_amount", "in_amount")


@entry("g15_account_nodes")
def g15(t: Tables):
    return network.graph_risk(network.account_nodes(t.bank))


_LOGS = ", ".join(f"ln(1 + abs(CAST({c} AS DOUBLE))) AS {c}" for c in STRUCTURAL)
_STATS = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in STRUCTURAL)
_CLIPPED = " + ".join(f"least(greatest(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 0), 6)" for c in STRUCTURAL)


@entry("g15_structural_score", f"""
WITH l AS (SELECT node, {_LOGS} FROM flow_deg), s AS (SELECT {_STATS} FROM l),
r AS (SELECT node, sqrt(({_CLIPPED}) / {len(STRUCTURAL)} / 6e0) AS raw FROM l, s), e AS (SELECT min(raw) AS lo, max(raw) AS hi FROM r)
SELECT node, CASE WHEN hi > lo THEN round((raw - lo) / (hi - lo) * 100, 2) ELSE 0 END AS graph_score FROM r, e""")
def g15b(t: Tables):
    return g.graph_score(g.degrees(g.flow_edges(t.bank), "amount"), list(STRUCTURAL), "node")


@entry("r5_account_composite_all_parts")
def r5(t: Tables):
    return network.account_scores(t.case, w=cp.WEIGHTS)


@entry("r6_account_risk_all_parts")
def r6(t: Tables):
    return network.account_risk(t.case, network.account_nodes(t.bank), ml.ensemble_scores(ft.account_matrix(t.case), ft.ACCOUNT_FEATURES))


@entry("r9_account_scenarios_all_parts")
def r9(t: Tables):
    found = network.account_scores(t.case, w=cp.WEIGHTS)
    return found.select("account_no", F.explode("scenarios").alias("s")).select("account_no", "s.scenario", "s.severity", "s.confidence")


@entry("r10_entity_composite_ranked")
def r10(t: Tables):
    return network.entity_scores(t.case, cp.WEIGHTS)


@entry("g18_hub_table")
def g18(t: Tables):
    return network.hub_table(g.money_edges(t.bank))


@entry("a19_executive_all_parts")
def a19(t: Tables):
    """The executive row over every loop, with the detectors' most unusual account in the overall risk, and all columns."""
    payouts = ft.rapid_payouts(t.bank)
    outliers = ml.outlier_list(ft.outlier_matrix(t.bank, payouts))
    return reports.executive(t.case, rules.account_heat(t.case), rules.phone_heat(t.cdr), g.circular_flows(t.bank, cap=None), payouts, links.coincidences(t.case).select("phone"), outliers)


@entry("g13_modularity_calls")
def g13(t: Tables):
    return modularity_communities(g.call_edges(t.cdr))


@entry("g13_modularity_accounts")
def g13b(t: Tables):
    return modularity_communities(g.flow_edges(t.bank))
