"""Graph edges, structure, traversal and centrality."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, entry, rounded, view
from weftline.operators import graphs as g
from weftline.operators.views import bank_legs
from weftline.session import cut

view("call_e", "SELECT a_number AS src, b_number AS dst, count(*) AS weight, CAST(sum(duration_sec) AS BIGINT) AS seconds FROM f_cdr GROUP BY 1, 2")
view("money_e", """
  SELECT CASE WHEN debit > 0 THEN account_no ELSE receiver_account END AS src, CASE WHEN debit > 0 THEN receiver_account ELSE account_no END AS dst,
    count(*) AS weight, sum(amount) AS amount FROM f_bank GROUP BY 1, 2""")
view("flow_e", """
  SELECT account_no AS src, CASE WHEN receiver_account IN (SELECT account_no FROM f_bank) THEN receiver_account ELSE 'CTP:' || receiver_account END AS dst,
    count(*) AS count, coalesce(sum(debit), 0) AS amount FROM f_bank GROUP BY 1, 2""")
view("layer_e", """
  SELECT src, dst, edge_type, count(*) AS count, sum(a) AS amount, CAST(sum(s) AS BIGINT) AS seconds FROM (
    SELECT sender_account AS src, receiver_account AS dst, 'bank_transfer' AS edge_type, amount AS a, 0 AS s FROM legs
    UNION ALL SELECT a_number, b_number, 'cdr_call', 0, duration_sec FROM f_cdr
    UNION ALL SELECT sender_account, sender_phone, 'account_phone_link', 0, 0 FROM legs
    UNION ALL SELECT receiver_account, receiver_phone, 'account_phone_link', 0, 0 FROM legs
    UNION ALL SELECT l.receiver_account, c.a_number, 'correlated_event', 0, 0 FROM bank_links b JOIN legs l USING (txn_id) JOIN f_cdr c USING (cdr_id)
    UNION ALL SELECT msisdn, dest_ip, 'ip_session', 0, 0 FROM f_ipdr
    UNION ALL SELECT a_number, imei, 'device_link', 0, 0 FROM f_cdr) GROUP BY 1, 2, 3""")


@entry("g1_call_edges", "SELECT * FROM call_e")
def g1(t: Tables):
    return g.call_edges(t.cdr)


@entry("g1_money_edges", "SELECT * FROM money_e")
def g1b(t: Tables):
    return g.money_edges(t.bank)


@entry("p11_money_edges_min", "SELECT * FROM money_e WHERE amount >= 400000 ORDER BY amount DESC, src, dst LIMIT 200")
def p11(t: Tables):
    return g.money_edges(t.bank).where("amount >= 400000").orderBy(F.desc("amount"), "src", "dst").limit(200)


@entry("g1_account_phone_edges", "SELECT DISTINCT account_no AS src, unnest([sender_phone, receiver_phone]) AS dst FROM f_bank")
def g1c(t: Tables):
    return g.account_phone_edges(t.bank)


@entry("g1_flow_edges", "SELECT * FROM flow_e")
def g1d(t: Tables):
    return g.flow_edges(t.bank)


def layered(t: Tables):
    return g.layered_edges(t.case, bank_legs(t.bank))


@entry("g2_layered_edges", "SELECT * FROM layer_e")
def g2(t: Tables):
    return layered(t)


_DEG = """SELECT node, sum(o) + sum(i) AS degree, sum(o) AS out_degree, sum(i) AS in_degree, sum(oa) AS out_amount, sum(ia) AS in_amount FROM (
  SELECT src AS node, 1 AS o, 0 AS i, amount AS oa, 0 AS ia FROM flow_e UNION ALL SELECT dst, 0, 1, 0, amount FROM flow_e) GROUP BY 1"""
view("flow_deg", _DEG.replace("sum(o) + sum(i) AS degree, sum(o) AS out_degree, sum(i) AS in_degree",
                              "count(*) AS degree, count(*) FILTER (WHERE o = 1) AS out_degree, count(*) FILTER (WHERE i = 1) AS in_degree"))


@entry("g3_degrees", "SELECT * FROM flow_deg")
def g3(t: Tables):
    return g.degrees(g.flow_edges(t.bank), "amount")


view("tie_e", "SELECT src, dst FROM call_e")
view("tie_reach", """
  SELECT node, node AS other FROM (SELECT src AS node FROM tie_e UNION SELECT dst FROM tie_e)
  UNION SELECT r.node, CASE WHEN e.src = r.other THEN e.dst ELSE e.src END FROM tie_reach r JOIN tie_e e ON e.src = r.other OR e.dst = r.other""")


def ties(t: Tables):
    return g.call_edges(t.cdr)


@entry("g3_components", "SELECT node, min(other) AS component FROM tie_reach GROUP BY 1")
def g3b(t: Tables):
    return g.components(ties(t))


@entry("g3_graph_summary", """
WITH c AS (SELECT component, count(*) AS k FROM (SELECT node, min(other) AS component FROM tie_reach GROUP BY 1) GROUP BY 1)
SELECT CAST(sum(k) AS BIGINT) AS nodes, (SELECT count(*) FROM tie_e) AS edges, round((SELECT count(*) FROM tie_e) / (sum(k) * (sum(k) - 1)), 4) AS density,
  count(*) AS components, max(k) AS largest_component FROM c""")
def g3c(t: Tables):
    return g.graph_summary(ties(t))


@entry("k6_central_phones", """
SELECT phone, degree, in_degree, out_degree, CAST(calls AS BIGINT) AS calls FROM (
  SELECT node AS phone, count(*) AS degree, count(*) FILTER (WHERE d = 'i') AS in_degree, count(*) FILTER (WHERE d = 'o') AS out_degree,
    coalesce(sum(w) FILTER (WHERE d = 'o'), 0) AS calls FROM (SELECT src AS node, 'o' AS d, weight AS w FROM call_e UNION ALL SELECT dst, 'i', weight FROM call_e) GROUP BY 1)
ORDER BY degree DESC, calls DESC, phone LIMIT 15""")
def k6(t: Tables):
    return g.central_phones(t.cdr)


view("seeds", "SELECT account_no AS node FROM f_complaint")
view("und_layer", "SELECT src, dst FROM layer_e WHERE src <> dst UNION SELECT dst, src FROM layer_e WHERE src <> dst")
view("hop1", "SELECT DISTINCT s.node AS seed, e.dst AS node FROM seeds s JOIN und_layer e ON e.src = s.node")
view("hop2", "SELECT DISTINCT h.seed, e.dst AS node FROM hop1 h JOIN und_layer e ON e.src = h.node")
view("hops", """
  SELECT seed, node, min(hop) AS hop FROM (
    SELECT node AS seed, node, 0 AS hop FROM seeds
    UNION ALL SELECT s.node, e.dst, 1 FROM seeds s JOIN und_layer e ON e.src = s.node
    UNION ALL SELECT h.seed, f.dst, 2 FROM hop1 h JOIN und_layer f ON f.src = h.node
    UNION ALL SELECT h.seed, f.dst, 3 FROM hop2 h JOIN und_layer f ON f.src = h.node) GROUP BY 1, 2""")
view("traced", """
  SELECT h.seed, e.src, e.dst, e.edge_type, min(h.hop) + 1 AS hop_distance, max(e.amount) AS amount FROM layer_e e JOIN hops h ON (h.node = e.src OR h.node = e.dst) AND h.hop < 3 GROUP BY 1, 2, 3, 4""")


def seeds(t: Tables):
    return t.complaints.select(F.col("account_no").alias("node")).distinct()


@entry("g4_trace_layers", "SELECT seed, node, hop FROM hops")
def g4(t: Tables):
    return g.trace(seeds(t), layered(t))[0]


@entry("g4_trace_edges", "SELECT * FROM traced")
def g4b(t: Tables):
    return g.trace(seeds(t), layered(t))[1]


@entry("g4_investigation_graph", """
WITH d AS (SELECT seed, node, count(*) AS degree FROM (SELECT seed, unnest([src, dst]) AS node FROM traced) GROUP BY 1, 2),
j AS (SELECT h.*, coalesce(round(coalesce(degree, 0) / max(degree) OVER (PARTITION BY h.seed), 2), 0) AS centrality FROM hops h LEFT JOIN d USING (seed, node))
SELECT seed, node, hop, centrality, CASE WHEN node = seed THEN 'Root Entity' WHEN centrality >= 0.7 THEN 'High-Centrality Hub' WHEN hop = 1 THEN 'Direct Mule / Layer-1'
  WHEN hop = 2 THEN 'Layer-2 Intermediate' ELSE 'Layer-3 Offramp' END AS role FROM j""")
def g4c(t: Tables):
    edges = cut(layered(t))
    return g.investigation_graph(g.reach(seeds(t), edges), edges)


@entry("g5_ego_network", """
WITH s AS (SELECT DISTINCT mobile AS seed FROM f_complaint),
n AS (SELECT seed, seed AS node FROM s UNION SELECT seed, dst FROM s JOIN call_e ON src = seed WHERE src <> dst)
SELECT n.seed, e.src, e.dst, e.weight, e.seconds FROM n JOIN call_e e ON e.src = n.node WHERE e.weight >= 2""")
def g5(t: Tables):
    s = t.complaints.select(F.col("mobile").alias("node")).distinct()
    return g.ego_network(g.call_edges(t.cdr), s, 1, 2)


def _cycles(minimum: int, longest: int) -> str:
    return f"""WITH RECURSIVE e AS (SELECT account_no AS src, receiver_account AS dst, sum(debit) AS amount FROM f_bank WHERE debit >= {minimum} AND account_no <> receiver_account GROUP BY 1, 2),
p AS (SELECT src AS start, dst AS cur, [src, dst] AS path, amount AS total, amount AS least_leg FROM e WHERE dst > src
  UNION ALL SELECT p.start, e.dst, list_append(p.path, e.dst), p.total + e.amount, least(p.least_leg, e.amount) FROM p JOIN e ON e.src = p.cur
  WHERE e.dst > p.start AND NOT list_contains(p.path, e.dst) AND len(p.path) < {longest})
SELECT array_to_string(path, ' > ') AS accounts, len(path) AS length, round(total + e.amount, 2) AS total_flow, round(least(least_leg, e.amount), 2) AS min_leg
FROM p JOIN e ON e.src = p.cur AND e.dst = p.start"""


@entry("g6_circular_flows", _cycles(200000, 4) + " ORDER BY total_flow DESC, accounts LIMIT 50")
def g6(t: Tables):
    return g.circular_flows(t.bank, 200000, 4).withColumn("accounts", F.array_join("accounts", " > "))


@entry("g6_circular_flows_every_loop")
def g6b(t: Tables):
    return g.circular_flows(t.bank).withColumn("accounts", F.array_join("accounts", " > "))


view("acc_e", "SELECT DISTINCT src, dst FROM flow_e WHERE NOT starts_with(dst, 'CTP:') AND src <> dst")
view("big_e", "SELECT DISTINCT account_no AS src, receiver_account AS dst FROM f_bank WHERE debit > 0 AND account_no <> receiver_account")
view("big_reach", "SELECT src, dst FROM big_e UNION SELECT r.src, e.dst FROM big_reach r JOIN big_e e ON e.src = r.dst")


@entry("g7_strong_components", """
SELECT a.src AS node, least(a.src, min(a.dst)) AS scc FROM big_reach a JOIN big_reach b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY 1""")
def g7(t: Tables):
    e = t.bank.where("debit > 0 and account_no <> receiver_account").select(
        F.col("account_no").alias("src"), F.col("receiver_account").alias("dst")).distinct()
    return g.strong_components(e).select("node", "scc")


view("depths", """
  WITH acc AS (SELECT account_no AS s FROM f_bank UNION SELECT dst FROM acc_e),
  d1 AS (SELECT src AS s, dst AS n FROM acc_e),
  d2 AS (SELECT DISTINCT d.s, e.dst AS n FROM d1 d JOIN acc_e e ON e.src = d.n WHERE e.dst <> d.s AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.s = d.s AND x.n = e.dst)),
  d3 AS (SELECT DISTINCT d.s, e.dst AS n FROM d2 d JOIN acc_e e ON e.src = d.n WHERE e.dst <> d.s AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.s = d.s AND x.n = e.dst)
      AND NOT EXISTS (SELECT 1 FROM d2 x WHERE x.s = d.s AND x.n = e.dst))
  SELECT s AS account_no, CASE WHEN s IN (SELECT s FROM d3) THEN 3 WHEN s IN (SELECT s FROM d2) THEN 2 WHEN s IN (SELECT s FROM d1) THEN 1 ELSE 0 END AS layering_depth FROM acc""")


@entry("g8_layering_depth", "SELECT * FROM depths")
def g8(t: Tables):
    return g.layering_depth(g.flow_edges(t.bank))


view("acc_reach", "SELECT src, dst FROM acc_e UNION SELECT r.src, e.dst FROM acc_reach r JOIN acc_e e ON e.src = r.dst")
view("mflow", """
  SELECT account_no, layering_depth, circular, cash_out_payouts, rapid_forward, mule_chain, CAST(least(100, CASE WHEN layering_depth >= 3 THEN 25 WHEN layering_depth = 2 THEN 10 ELSE 0 END
    + CASE WHEN circular THEN 30 ELSE 0 END + CASE WHEN cash_out_payouts >= 8 THEN 25 WHEN cash_out_payouts >= 4 THEN 15 ELSE 0 END
    + CASE WHEN rapid_forward THEN 15 ELSE 0 END + CASE WHEN mule_chain THEN 15 ELSE 0 END) AS DOUBLE) AS flow_score
  FROM (SELECT a.account_no, layering_depth, a.account_no IN (SELECT src FROM acc_reach WHERE src = dst) AS circular, coalesce(f.k, 0) AS cash_out_payouts,
      coalesce(in_degree, 0) >= 3 AND deb >= 100000 AS rapid_forward, coalesce(out_degree, 0) >= 3 AND coalesce(in_degree, 0) >= 2 AND layering_depth >= 2 AS mule_chain
    FROM (SELECT account_no, coalesce(sum(debit), 0) AS deb FROM f_bank GROUP BY 1) a JOIN depths USING (account_no)
    LEFT JOIN (SELECT account_no, count(DISTINCT receiver_account) AS k FROM f_bank WHERE debit >= 10000 GROUP BY 1) f USING (account_no)
    LEFT JOIN flow_deg d ON d.node = a.account_no)""")


@entry("g9_money_flow", "SELECT * FROM mflow")
def g9(t: Tables):
    return g.money_flow(t.bank).drop("reasons")


@entry("g10_pagerank")
def g10(t: Tables):
    return rounded(g.pagerank(g.flow_edges(t.bank)), 8)


@entry("g10_pagerank_calls")
def g10b(t: Tables):
    return rounded(g.pagerank(g.call_edges(t.cdr)), 8)


@entry("g11_betweenness")
def g11(t: Tables):
    return rounded(g.betweenness(g.flow_edges(t.bank)), 8)


@entry("g12_clustering", """
WITH u AS (SELECT src, dst FROM flow_e WHERE src <> dst UNION SELECT dst, src FROM flow_e WHERE src <> dst),
d AS (SELECT src AS node, count(*) AS k FROM u GROUP BY 1),
t AS (SELECT a.src AS node, count(*) AS t FROM u a JOIN u b ON a.src = b.src AND a.dst < b.dst JOIN u c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1)
SELECT n.node, round(CASE WHEN k > 1 THEN 2 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END, 6) AS clustering FROM (SELECT src AS node FROM flow_e UNION SELECT dst FROM flow_e) n
LEFT JOIN d USING (node) LEFT JOIN t USING (node)""")
def g12(t: Tables):
    return rounded(g.clustering(g.flow_edges(t.bank)), 6)


@entry("g13_communities")
def g13(t: Tables):
    return g.communities(g.call_edges(t.cdr))


@entry("g16_bridges")
def g16(t: Tables):
    return g.bridges(ties(t))


@entry("g16_average_path_length")
def g16b(t: Tables):
    return g.average_path_length(ties(t))


def _layer(src: str, phone: str, ident: str) -> str:
    return f"""WITH u AS (SELECT {phone} AS phone, {ident} AS identifier, count(*) AS records FROM {src} GROUP BY 1, 2),
m AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY phone ORDER BY records DESC, identifier) <= 6)
SELECT m.phone, m.identifier, m.records AS own_records, p.phone AS peer, p.records AS peer_records,
  row_number() OVER (PARTITION BY m.phone, m.identifier ORDER BY p.records DESC, p.phone) AS n FROM m JOIN u p ON p.identifier = m.identifier AND p.phone <> m.phone QUALIFY n <= 8"""


@entry("g17_device_layer", _layer("f_cdr", "a_number", "imei"))
def g17(t: Tables):
    return g.device_layer(t.cdr)


@entry("g17_ip_layer", _layer("f_ipdr", "msisdn", "source_ip"))
def g17b(t: Tables):
    return g.ip_layer(t.ipdr)


@entry("g18_hubs", """
SELECT node, degree, in_degree, out_degree FROM (SELECT node, count(*) AS degree, count(*) FILTER (WHERE d = 'i') AS in_degree, count(*) FILTER (WHERE d = 'o') AS out_degree
  FROM (SELECT src AS node, 'o' AS d FROM money_e UNION ALL SELECT dst, 'i' FROM money_e) GROUP BY 1) ORDER BY degree DESC, node LIMIT 25""")
def g18(t: Tables):
    return g.hubs(g.money_edges(t.bank)).select("node", "degree", "in_degree", "out_degree")
