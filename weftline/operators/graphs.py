"""Graph edges and iterative graph jobs on DataFrames.

Edges are always collapsed to one row per (src, dst) first, so repeated contacts of a hot pair never
travel. Loops write each round to the checkpoint folder; only round counters and one-row totals reach
the driver.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.case import Case
from weftline.operators.links import bank_call_links
from weftline.operators.ordering import with_position, with_scalars
from weftline.session import cut

CTP = "CTP:"
# Seeds of a trace are kept as bits, so many words of 64 in a row.
WORDS = 16
SEEDS = 64 * WORDS


# ---------------------------------------------------------------- edges

def call_edges(cdr: DataFrame) -> DataFrame:
    return (cdr.where("a_number is not null and b_number is not null")
            .groupBy(F.col("a_number").alias("src"), F.col("b_number").alias("dst"))
            .agg(F.count(F.lit(1)).alias("weight"), F.sum(F.coalesce("duration_sec", F.lit(0))).alias("seconds")))


def money_edges(bank: DataFrame) -> DataFrame:
    """Account and counterparty in the direction the money moved."""
    target = F.coalesce("receiver_account", "upi_id", "counterparty_name", "receiver_phone")
    out = F.coalesce("debit", F.lit(0.0)) > 0
    rows = bank.where(F.col("account_no").isNotNull() & target.isNotNull())
    return (rows.groupBy(F.when(out, F.col("account_no")).otherwise(target).alias("src"),
                         F.when(out, target).otherwise(F.col("account_no")).alias("dst"))
            .agg(F.count(F.lit(1)).alias("weight"),
                 F.sum(F.when(out, F.col("debit")).otherwise(F.coalesce("credit", F.lit(0.0)))).alias("amount")))


def account_phone_edges(bank: DataFrame) -> DataFrame:
    return (bank.where("account_no is not null")
            .select(F.col("account_no").alias("src"), F.explode(F.array_compact(F.array("receiver_phone", "sender_phone"))).alias("dst"))
            .distinct())


def flow_edges(bank: DataFrame) -> DataFrame:
    """Account to account, or to a ``CTP:`` node when the receiver has no ledger of its own."""
    rows = bank.where("account_no is not null")
    pre = rows.groupBy("account_no", "receiver_account", F.when(F.col("receiver_account").isNull(), F.coalesce(
        F.substring("counterparty_name", 1, 40), F.lit("?"))).alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.coalesce("debit", F.lit(0.0)), F.lit(0.0))).alias("amt"))
    ledger = rows.select(F.col("account_no").alias("receiver_account")).distinct().withColumn("own", F.lit(True))
    j = pre.join(ledger, "receiver_account", "left")
    dst = F.when(F.col("own"), F.col("receiver_account")).otherwise(
        F.concat(F.lit(CTP), F.coalesce("receiver_account", "name")))
    return j.groupBy(F.col("account_no").alias("src"), dst.alias("dst")).agg(F.sum("n").alias("count"), F.sum("amt").alias("amount"))


def layered_edges(case: Case, legs: DataFrame) -> DataFrame:
    """Typed edges of all layers, one row per (src, dst, type) with count, amount and seconds.

    Linked payments and calls become counts of (account, phone) where they are found.
    """
    zero, nought = F.lit(0.0), F.lit(0).cast("long")

    def typed(df, kind, src, dst, amount=zero, seconds=nought):
        return (df.where(src.isNotNull() & dst.isNotNull())
                .select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"), amount.alias("a"), seconds.alias("s"))
                .groupBy("src", "dst", "edge_type").agg(F.count(F.lit(1)).alias("count"), F.sum("a").alias("amount"),
                                                        F.sum("s").alias("seconds")))

    c = F.col
    owner = bank_call_links(case, pay=legs.select("txn_id", F.coalesce("receiver_account", "sender_account").alias("acc")),
                            call=case.cdr.select("cdr_id", F.coalesce("a_number", "b_number").alias("ph")))
    parts = [
        typed(legs, "bank_transfer", c("sender_account"), c("receiver_account"), c("amount")),
        typed(case.cdr, "cdr_call", c("a_number"), c("b_number"), seconds=F.coalesce("duration_sec", nought).cast("long")),
        typed(legs, "account_phone_link", c("sender_account"), c("sender_phone")),
        typed(legs, "account_phone_link", c("receiver_account"), c("receiver_phone")),
        typed(owner, "correlated_event", c("acc"), c("ph")),
        typed(case.ipdr, "ip_session", c("msisdn"), c("dest_ip")),
        typed(case.cdr, "device_link", c("a_number"), c("imei")),
    ]
    return (reduce(DataFrame.unionByName, parts).groupBy("src", "dst", "edge_type")
            .agg(F.sum("count").alias("count"), F.sum("amount").alias("amount"), F.sum("seconds").alias("seconds")))


# ---------------------------------------------------------------- structure

def degrees(edges: DataFrame, amount: str | None = None) -> DataFrame:
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), (F.col(amount) if amount else F.lit(0.0)).alias("oa"), F.lit(0.0).alias("ia")),
        F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0.0).alias("oa"), (F.col(amount) if amount else F.lit(0.0)).alias("ia"))))
        .alias("e")).select("e.*")
    g = ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"),
                                 F.sum("oa").alias("out_amount"), F.sum("ia").alias("in_amount"))
    return g.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def central_phones(cdr: DataFrame, top: int = 15) -> DataFrame:
    e = call_edges(cdr)
    calls = e.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("calls"))
    d = degrees(e).join(calls, "node", "left").withColumn("calls", F.coalesce("calls", F.lit(0)))
    return d.select(F.col("node").alias("phone"), "degree", "in_degree", "out_degree", "calls").orderBy(
        F.desc("degree"), F.desc("calls"), "phone").limit(top)


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions, no loops, distinct."""
    e = edges.where("src <> dst").select("src", "dst")
    return e.union(e.select("dst", "src")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): alternating large-star and small-star contraction to the smallest member.

    Rounds grow with the logarithm of the size, not with the diameter; every step is one aggregate and
    one join whose second side has a single row per node.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    work = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    last = None
    for _ in range(max_rounds):
        both = work.union(work.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low2, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        work = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        mark = work.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = work.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(root, nodes.node == root.u, "left").select("node", F.coalesce("m", "node").alias("component"))


def graph_summary(edges: DataFrame) -> DataFrame:
    """Nodes, edges, density, weak components and largest component in one row."""
    comp = components(edges)
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("k"))
    s = sizes.agg(F.sum("k").alias("nodes"), F.count(F.lit(1)).alias("components"), F.max("k").alias("largest_component"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"))
    n, m = F.col("nodes"), F.col("scalars")["edges"]
    return with_scalars(s, e).select("nodes", m.alias("edges"), F.when(n > 1, F.round(m / (n * (n - 1)), 4)).otherwise(0.0).alias("density"),
                                     "components", "largest_component")


# ---------------------------------------------------------------- traversal

def hop_layers(seeds: DataFrame, adjacency: DataFrame, max_hops: int = 3) -> DataFrame:
    """(seed, node, hop) by breadth-first frontier joins for a set of seeds."""
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, max_hops + 1):
        step = (frontier.select("seed", F.col("node").alias("src")).join(adjacency.select("src", "dst"), "src")
                .select("seed", F.col("dst").alias("node")).distinct()
                .join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        frontier = cut(step)
        seen = seen.unionByName(frontier)
    return seen


class Reach(NamedTuple):
    """What many seeds reach, as bits: seed number ``no`` is bit ``no % 64`` of word ``no // 64 % WORDS`` in block ``no // SEEDS``.

    ``levels`` has one row per node and block with arrays ``l0`` to ``l<hops>``: the seeds within so many hops of the node.
    """
    levels: DataFrame
    numbered: DataFrame
    apart: DataFrame
    hops: int


def reach(seeds: DataFrame, edges: DataFrame, max_hops: int = 3) -> Reach:
    """Breadth-first search of all seeds at once, both directions; pairs of seed and node are never formed.

    Seeds without an edge stay ``apart``; they reach themselves only.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    asked = seeds.select("node").distinct()
    spread = asked.join(nodes, "node", "left_semi").select("node", F.lit(0).alias("all"), F.pmod(F.xxhash64("node"), F.lit(4096)).alias("hb"))
    numbered = cut(with_position(spread, ["all"], "node", ts="hb", width=64).select(F.col("node").alias("seed"), F.col("pos").cast("long").alias("no")))
    adj = cut(undirected(edges))
    zero = F.lit(0).cast("long")
    bit = F.expr("shiftleft(1L, int(no % 64))")
    near = numbered.select(F.col("seed").alias("node"), F.expr(f"no div {SEEDS}").alias("block"), F.array(*[
        F.when(F.expr(f"no % {SEEDS} div 64 = {w}"), bit).otherwise(zero) for w in range(WORDS)]).alias("l0"))
    none = F.array(*[zero] * WORDS)
    for hop in range(1, max_hops + 1):
        last = near.select("node", "block", F.col(f"l{hop - 1}").alias("b"))
        step = adj.join(last.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "block", "b").unionByName(last)
        grown = step.groupBy("node", "block").agg(_any_bit("b", f"l{hop}"))
        near = cut(grown.join(near, ["node", "block"], "left").select(
            "node", "block", *[F.coalesce(f"l{h}", none).alias(f"l{h}") for h in range(hop)], f"l{hop}"))
    return Reach(near, numbered, asked.join(numbered.select(F.col("seed").alias("node")), "node", "left_anti"), max_hops)


def _any_bit(bits: str, out: str) -> Column:
    return F.array(*[F.bit_or(F.col(bits)[w]) for w in range(WORDS)]).alias(out)


def _each_seed(found: Reach, rows: DataFrame, levels: list[str], *keep: str) -> DataFrame:
    """One row for each seed of the last of ``levels``, with the place of the first level that holds it as ``hop``."""
    words = rows.select(*keep, "block", F.posexplode(F.arrays_zip(*levels)).alias("w", "b")).where(F.col("b")[levels[-1]] != 0)
    bits = words.withColumn("i", F.explode(F.array(*map(F.lit, range(64)))))
    has = lambda c: F.expr(f"(shiftright(b.{c}, i) & 1L) = 1L")
    hop = reduce(lambda late, h: F.when(has(levels[h]), F.lit(h)).otherwise(late), reversed(range(len(levels) - 1)), F.lit(len(levels) - 1))
    at = bits.where(has(levels[-1])).select(*keep, (F.col("block") * SEEDS + F.col("w") * 64 + F.col("i")).alias("no"), hop.alias("hop"))
    # one short row per seed, against rows that would otherwise all be shuffled
    return at.join(F.broadcast(found.numbered), "no").drop("no")


def _levels(n: int) -> list[str]:
    return [f"l{h}" for h in range(n)]


def reached_layers(found: Reach) -> DataFrame:
    """(seed, node, hop) of every seed."""
    rows = _each_seed(found, found.levels, _levels(found.hops + 1), "node").select("seed", "node", "hop")
    return rows.unionByName(found.apart.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop")))


def reach_sizes(found: Reach) -> DataFrame:
    """(seed, nodes, farthest_hop): nodes that the same seeds reach in the same way are counted before seeds are told apart."""
    levels = _levels(found.hops + 1)
    alike = found.levels.groupBy("block", *levels).agg(F.count(F.lit(1)).alias("n"))
    sizes = _each_seed(found, alike, levels, "n").groupBy("seed").agg(F.sum("n").alias("nodes"), F.max("hop").alias("farthest_hop"))
    return sizes.unionByName(found.apart.select(F.col("node").alias("seed"), F.lit(1).cast("long").alias("nodes"), F.lit(0).alias("farthest_hop")))


def _touched(found: Reach, edges: DataFrame, levels: list[str]) -> DataFrame:
    """Edges and blocks with the seeds that touch them within each of ``levels``, by the nearer end."""
    ends = edges.select("src", "dst", "edge_type", "amount", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    return (ends.join(found.levels.select("node", "block", *levels), "node").groupBy("src", "dst", "edge_type", "block")
            .agg(F.max("amount").alias("amount"), *[_any_bit(c, c) for c in levels]))


def reached_edges(found: Reach, edges: DataFrame) -> DataFrame:
    """Typed edges that each seed touches before its last layer. An edge between two expanded nodes is counted once."""
    levels = _levels(found.hops)
    rows = _each_seed(found, _touched(found, edges, levels), levels, "src", "dst", "edge_type", "amount")
    return rows.select("seed", "src", "dst", "edge_type", (F.col("hop") + 1).alias("hop_distance"), "amount")


def reached_totals(found: Reach, edges: DataFrame, within: int | None = None) -> DataFrame:
    """(seed, edges, total) of ``reached_edges``; edges that the same seeds touch are added before seeds are told apart.

    Edges count that a seed touches ``within`` so many hops, all but the last if not given: only that level is read, so a
    search for totals alone may stop there.
    """
    last = f"l{found.hops - 1 if within is None else within}"
    alike = _touched(found, edges, [last]).groupBy("block", last).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("t"))
    return _each_seed(found, alike, [last], "n", "t").groupBy("seed").agg(F.sum("n").alias("edges"), F.sum("t").alias("total"))


def trace(seeds: DataFrame, edges: DataFrame, max_hops: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes with hop layer and typed edges touched before the last layer, both directions."""
    edges = cut(edges)
    found = reach(seeds, edges, max_hops)
    return reached_layers(found), reached_edges(found, edges)


def investigation_graph(found: Reach, edges: DataFrame) -> DataFrame:
    """Trace nodes with relative degree and a role.

    All edges of a node before the last layer are traced, so its degree is that of the whole graph; a node of the last
    layer has the edges to the layer before.
    """
    inner, outer = f"l{found.hops - 1}", f"l{found.hops}"
    both = edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select(
        F.col("e.src").alias("node"), F.col("e.dst").alias("peer"))
    degree = both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    near = _each_seed(found, found.levels.join(degree, "node"), _levels(found.hops), "node", "degree").select("seed", "node", "hop", "degree")
    side = both.join(found.levels.select(F.col("node").alias("peer"), "block", F.col(inner).alias("b")), "peer").groupBy("node", "block", "b").agg(
        F.count(F.lit(1)).alias("k"))
    only = found.levels.select("node", "block", F.zip_with(outer, inner, lambda x, y: x.bitwiseAND(F.bitwise_not(y))).alias("only"))
    side = side.join(only, ["node", "block"]).select("node", "block", "k", F.zip_with("b", "only", lambda x, y: x.bitwiseAND(y)).alias("b"))
    far = _each_seed(found, side, ["b"], "node", "k").groupBy("node", "seed").agg(F.sum("k").alias("degree")).select(
        "seed", "node", F.lit(found.hops).alias("hop"), "degree")
    own = found.apart.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop"), F.lit(0).cast("long").alias("degree"))
    rows = near.unionByName(far)
    top = rows.groupBy("seed").agg(F.max("degree").alias("top"))
    j = rows.join(F.broadcast(top), "seed").unionByName(own.withColumn("top", F.lit(1).cast("long")))
    cent = F.round(F.col("degree") / F.col("top"), 2)
    role = (F.when(F.col("node") == F.col("seed"), "Root Entity").when(cent >= 0.7, "High-Centrality Hub")
            .when(F.col("hop") == 1, "Direct Mule / Layer-1").when(F.col("hop") == 2, "Layer-2 Intermediate")
            .otherwise("Layer-3 Offramp"))
    return j.select("seed", "node", "hop", cent.alias("centrality"), role.alias("role"))


def ego_network(edges: DataFrame, seeds: DataFrame, radius: int = 1, min_weight: int = 0) -> DataFrame:
    """Out-edges of every node within ``radius`` out-steps of a seed."""
    inside = hop_layers(seeds, edges.where("src <> dst"), radius)
    out = inside.select("seed", F.col("node").alias("src")).join(edges, "src")
    return out.where(F.col("weight") >= min_weight) if min_weight else out


def peel(edges: DataFrame, rounds: int = 6) -> DataFrame:
    """Drop edges that cannot lie on a cycle: an end without a way in or without a way out."""
    e = edges.where("src <> dst")
    last = None
    for _ in range(rounds):
        ok = e.select(F.col("src").alias("n")).distinct().intersect(e.select(F.col("dst").alias("n")).distinct())
        e = cut(e.join(ok.withColumnRenamed("n", "src"), "src", "left_semi").join(ok.withColumnRenamed("n", "dst"), "dst", "left_semi"))
        size = e.count()
        if size == last:
            break
        last = size
    return e


def circular_flows(bank: DataFrame, min_amount: float = 10000.0, max_len: int = 6, cap: int | None = 50) -> DataFrame:
    """Simple cycles of 2 to ``max_len`` accounts on debits of at least ``min_amount``.

    A cycle starts at its smallest account. Paths grow by joining on the current account after peeling.
    ``cap`` keeps the largest flows; None keeps all.
    """
    e = (bank.where(F.col("account_no").isNotNull() & F.col("receiver_account").isNotNull()
                    & (F.coalesce("debit", F.lit(0.0)) >= min_amount))
         .groupBy(F.col("account_no").alias("src"), F.col("receiver_account").alias("dst"))
         .agg(F.sum("debit").alias("amount")))
    return enumerate_cycles(peel(e), max_len, cap)


def enumerate_cycles(e: DataFrame, max_len: int = 6, cap: int | None = None) -> DataFrame:
    step = e.select(F.col("src").alias("cur"), F.col("dst").alias("nxt"), F.col("amount").alias("leg"))
    paths = step.where("nxt > cur").select(F.col("cur").alias("start"), F.col("nxt").alias("cur"), F.array("cur", "nxt").alias("path"),
                                           F.col("leg").alias("total"), F.col("leg").alias("least_leg"))
    found = None
    for length in range(2, max_len + 1):
        grown = paths.join(step, "cur").select("start", "nxt", "path", (F.col("total") + F.col("leg")).alias("total"),
                                               F.least("least_leg", "leg").alias("least_leg"))
        if length < max_len:
            grown = cut(grown)
        closed = grown.where("nxt = start").select(F.col("path").alias("accounts"), "total", "least_leg")
        found = closed if found is None else found.unionByName(closed)
        paths = grown.where(F.expr("nxt > start and not array_contains(path, nxt)")).select(
            "start", F.col("nxt").alias("cur"), F.concat("path", F.array("nxt")).alias("path"), "total", "least_leg")
    out = found.select("accounts", F.size("accounts").alias("length"), F.round("total", 2).alias("total_flow"),
                       F.round("least_leg", 2).alias("min_leg"))
    return out.orderBy(F.desc("total_flow"), "accounts").limit(cap) if cap else out


def strong_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, scc) for nodes in a strongly connected component of at least two nodes.

    Peel, colour every node with the smallest node that reaches it, then walk back from each colour's
    root inside its colour; what is met is one component. Repeat on the rest.
    """
    left = peel(edges.select("src", "dst").distinct(), 20)
    found = None
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        nodes = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colour = cut(nodes.select("node", F.col("node").alias("c")))
        while True:
            push = left.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("p"))
            nxt = cut(colour.join(push, "node", "left").select("node", "c", F.least("c", F.coalesce("p", "c")).alias("n")))
            changed = nxt.where("n <> c").limit(1).count()
            colour = nxt.select("node", F.col("n").alias("c"))
            if not changed:
                break
        colour = cut(colour)
        same = (left.join(colour.toDF("src", "cs"), "src").join(colour.toDF("dst", "cd"), "dst").where("cs = cd")
                .select("src", "dst", F.col("cs").alias("c")))
        same = cut(same)
        seen = cut(colour.where("node = c"))
        front = seen
        while True:
            back = (same.join(front.toDF("dst", "c"), ["dst", "c"]).select(F.col("src").alias("node"), "c").distinct()
                    .join(seen, ["node", "c"], "left_anti"))
            front = cut(back)
            if front.isEmpty():
                break
            seen = cut(seen.unionByName(front))
        found = seen if found is None else found.unionByName(seen)
        rest = left.join(seen.select(F.col("node").alias("src")), "src", "left_anti").join(
            seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        left = peel(rest, 20)
    else:
        raise RuntimeError(f"strong components left over after {max_rounds} rounds")
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("scc")).limit(0)
    sizes = found.groupBy("c").agg(F.count(F.lit(1)).alias("k")).where("k >= 2")
    return found.join(sizes, "c").select("node", F.col("c").alias("scc"), F.col("k").alias("scc_size"))


def circular_accounts(flow: DataFrame) -> DataFrame:
    """Accounts on a ring of any length: the members of strong components of two accounts or more."""
    inner = flow.where(~F.col("dst").startswith(CTP)).select("src", "dst")
    return strong_components(inner).select(F.col("node").alias("account_no")).distinct()


def layering_depth(flow: DataFrame, cutoff: int = 3, width: int = 16) -> DataFrame:
    """Per account: farthest hop (at most ``cutoff``) at which a new account is reached.

    Each account keeps the ``width`` accounts with the smallest hashes among those within h hops, built from its neighbours' own.
    One that was not there a hop before proves the hop; fewer than ``width`` are all there are. Only accounts that this leaves
    open are expanded in full, so the rows of a round are bounded by edges times ``width``.
    """
    adj = cut(flow.where(~F.col("dst").startswith(CTP) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct())
    sources = flow.select(F.explode(F.array("src", "dst")).alias("node")).where(~F.col("node").startswith(CTP)).distinct()
    near = cut(sources.select("node", F.col("node").alias("met"), F.lit(0).alias("hop")))
    first = W.partitionBy("node").orderBy(F.xxhash64("met"), "met")
    for hop in range(1, cutoff + 1):
        step = adj.join(near.select(F.col("node").alias("dst"), "met"), "dst").select(F.col("src").alias("node"), "met", F.lit(hop).alias("hop"))
        seen = step.unionByName(near).groupBy("node", "met").agg(F.min("hop").alias("hop"))
        near = cut(seen.withColumn("place", F.row_number().over(first)).where(F.col("place") <= width).drop("place"))
    depth = near.groupBy("node").agg(F.max("hop").alias("depth"), F.count(F.lit(1)).alias("kept"))
    still_open = (F.col("depth") < cutoff) & (F.col("kept") >= width)
    depth = cut(depth.withColumn("open", still_open))
    rest = hop_layers(depth.where("open").select("node"), adj, cutoff).groupBy(F.col("seed").alias("node")).agg(F.max("hop").alias("depth"))
    return depth.where("not open").select("node", "depth").unionByName(rest).select(
        F.col("node").alias("account_no"), F.col("depth").alias("layering_depth"))


def money_flow(bank: DataFrame, flow: DataFrame | None = None, min_edge: float = 10000.0) -> DataFrame:
    """Flow score per account from depth, rings, fan-out, forwarding and chain position."""
    flow = flow if flow is not None else flow_edges(bank)
    accounts = bank.where("account_no is not null").groupBy("account_no").agg(F.coalesce(F.sum("debit"), F.lit(0.0)).alias("deb"))
    fan = bank.where(F.coalesce("debit", F.lit(0.0)) >= min_edge).groupBy("account_no").agg(
        F.count_distinct("receiver_account").alias("cash_out_payouts"))
    deg = degrees(flow).select(F.col("node").alias("account_no"), "in_degree", "out_degree")
    ring = circular_accounts(flow).withColumn("circular", F.lit(True))
    depth = layering_depth(flow)
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    j = accounts
    for part in (fan, deg, ring, depth):
        j = j.join(part, "account_no", "left")
    j = j.select("account_no", "deb", z("cash_out_payouts"), z("in_degree"), z("out_degree"), z("layering_depth"),
                 F.coalesce("circular", F.lit(False)).alias("circular"))
    d, fo = F.col("layering_depth"), F.col("cash_out_payouts")
    rapid = (F.col("in_degree") >= 3) & (F.col("deb") >= 100000)
    mule = (F.col("out_degree") >= 3) & (F.col("in_degree") >= 2) & (d >= 2)
    on = lambda c, p: F.when(c, float(p)).otherwise(0.0)
    score = (F.when(d >= 3, 25.0).when(d == 2, 10.0).otherwise(0.0) + on(F.col("circular"), 30)
             + F.when(fo >= 8, 25.0).when(fo >= 4, 15.0).otherwise(0.0) + on(rapid, 15) + on(mule, 15))
    reasons = F.array_compact(F.array(
        F.when(d >= 3, F.concat(F.lit("funds layer through "), d.cast("string"), F.lit(" hops"))).when(d == 2, F.lit("funds reach accounts 2 hops away")),
        F.when(F.col("circular"), "part of a circular money-flow ring"),
        F.when(fo >= 4, F.concat(F.lit("radiates "), fo.cast("string"), F.lit(" high-value payouts"))),
        F.when(rapid, "receives from many sources and forwards large totals"), F.when(mule, "mid-chain node on a forwarding path")))
    return j.select("account_no", "layering_depth", "circular", "cash_out_payouts", rapid.alias("rapid_forward"), mule.alias("mule_chain"),
                    F.least(F.lit(100.0), score).alias("flow_score"), reasons.alias("reasons"))


# ---------------------------------------------------------------- centrality

def pagerank(edges: DataFrame, damping: float = 0.85, tol: float = 1e-6, max_iter: int = 100) -> DataFrame:
    """(node, pagerank): uniform teleport, dangling mass spread evenly; stops when total change < n * tol."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    e = cut(e.join(out, "src"))
    nodes = cut(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(
        out.select(F.col("src").alias("node"), "k"), "node", "left"))
    n = nodes.count()
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("pagerank"))
    ranks = nodes.select("node", "k", F.lit(1.0 / n).alias("r"))
    for _ in range(max_iter):
        inflow = e.join(ranks.select(F.col("node").alias("src"), "r"), "src").groupBy(F.col("dst").alias("node")).agg(
            F.sum(F.col("r") / F.col("k")).alias("inn"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("r"))), F.lit(0.0)).alias("lost"))
        nxt = with_scalars(ranks.join(inflow, "node", "left"), lost).select(
            "node", "k", F.col("r").alias("old"),
            (damping * (F.coalesce("inn", F.lit(0.0)) + F.col("scalars")["lost"] / n) + (1 - damping) / n).alias("r"))
        nxt = cut(nxt)
        err = nxt.agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0]
        ranks = nxt.select("node", "k", "r")
        if err < n * tol:
            break
    return ranks.select("node", F.col("r").alias("pagerank"))


def shortest_paths(edges: DataFrame, sources: DataFrame, max_depth: int = 10_000) -> tuple[DataFrame, int]:
    """(source, node, dist, sigma) with shortest-path counts, and the largest distance."""
    adj = cut(edges.where("src <> dst").select("src", "dst").distinct())
    seen = cut(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("dist"), F.lit(1.0).alias("sigma")))
    front, depth = seen, 0
    while depth < max_depth:
        step = (front.select("source", F.col("node").alias("src"), "sigma").join(adj, "src")
                .groupBy("source", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
                .join(seen.select("source", "node"), ["source", "node"], "left_anti")
                .select("source", "node", F.lit(depth + 1).alias("dist"), "sigma"))
        front = cut(step)
        if front.isEmpty():
            break
        depth += 1
        seen = cut(seen.unionByName(front))
    return seen, depth


def sampled_nodes(nodes: DataFrame, k: int) -> DataFrame:
    """``k`` nodes in md5 order: the same choice on every run."""
    return nodes.select("node").orderBy(F.md5("node"), "node").limit(k)


def betweenness(edges: DataFrame, samples: int = 30) -> DataFrame:
    """(node, betweenness), normalised, estimated from shortest paths out of ``samples`` nodes (of all, if there are fewer)."""
    e = cut(edges.where("src <> dst").select("src", "dst").distinct())
    nodes = cut(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    n = nodes.count()
    k = min(n, samples)
    paths, depth = shortest_paths(e, sampled_nodes(nodes, k))
    delta = None
    acc = None
    for d in range(depth, 0, -1):
        far = paths.where(F.col("dist") == d).select("source", F.col("node").alias("dst"), F.col("sigma").alias("sw"))
        if delta is not None:
            far = far.join(delta.select("source", F.col("node").alias("dst"), "delta"), ["source", "dst"], "left")
        else:
            far = far.withColumn("delta", F.lit(0.0))
        near = paths.where(F.col("dist") == d - 1).select("source", F.col("node").alias("src"), F.col("sigma").alias("sv"))
        delta = cut(far.join(e, "dst").join(near, ["source", "src"]).groupBy("source", F.col("src").alias("node")).agg(
            F.sum(F.col("sv") / F.col("sw") * (1.0 + F.coalesce("delta", F.lit(0.0)))).alias("delta")))
        part = delta.where("node <> source").groupBy("node").agg(F.sum("delta").alias("b"))
        acc = part if acc is None else acc.unionByName(part)
    if acc is None or n < 3:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    total = acc.groupBy("node").agg(F.sum("b").alias("b"))
    scale = 1.0 / ((n - 1) * (n - 2)) * (n / k)
    return nodes.join(total, "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def clustering(edges: DataFrame) -> DataFrame:
    """(node, clustering): closed share of neighbour pairs.

    Each edge points from the lower-degree end to the higher, so a hub opens few wedges and no node has
    more than about the square root of twice the edges going out.
    """
    u = undirected(edges)
    deg = u.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    d = u.join(deg.toDF("src", "ds"), "src").join(deg.toDF("dst", "dd"), "dst")
    up = cut(d.where("ds < dd or (ds = dd and src < dst)").select("src", "dst"))
    wedge = up.toDF("a", "b").join(up.toDF("a", "c"), "a").where("b < c")
    close = u.toDF("b", "c")
    tri = wedge.join(close, ["b", "c"]).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(
        F.count(F.lit(1)).alias("t"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    j = nodes.join(deg, "node", "left").join(tri, "node", "left")
    k = F.coalesce("deg", F.lit(0))
    return j.select("node", F.when(k > 1, 2.0 * F.coalesce("t", F.lit(0)) / (k * (k - 1))).otherwise(0.0).alias("clustering"))


def communities(edges: DataFrame, max_iter: int = 20) -> DataFrame:
    """(node, community, community_size) by synchronous label propagation; ties go to the smallest label."""
    u = cut(undirected(edges))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    labels = cut(nodes.select("node", F.col("node").alias("label")))
    for _ in range(max_iter):
        votes = (u.join(labels.select(F.col("node").alias("dst"), "label"), "dst").select(F.col("src").alias("node"), "label")
                 .unionByName(labels).groupBy("node", "label").agg(F.count(F.lit(1)).alias("k")))
        best = votes.groupBy("node").agg(F.min_by("label", F.struct(-F.col("k"), "label")).alias("best"))
        nxt = cut(labels.join(best, "node"))
        changed = nxt.where("best <> label").limit(1).count()
        labels = nxt.select("node", F.col("best").alias("label"))
        if not changed:
            break
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("community_size"))
    return labels.join(sizes, "label").select("node", F.col("label").alias("community"), "community_size")


def bridges(edges: DataFrame) -> DataFrame:
    """Edges whose removal splits their component, as (u, v) with u < v.

    Breadth-first spanning forest; every non-tree edge gets a 64-bit label, labels are XOR-ed up the tree,
    and a tree edge that no label crosses is a bridge (an accidental zero has probability 2^-64).
    """
    u = cut(undirected(edges))
    comp = components(u)
    roots = comp.select(F.col("component").alias("node")).distinct()
    tree = cut(roots.select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level")))
    front, level = tree, 0
    while True:
        step = (u.join(front.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
                .join(tree.select("node"), "node", "left_anti").withColumn("level", F.lit(level + 1)))
        front = cut(step)
        if front.isEmpty():
            break
        level += 1
        tree = cut(tree.unionByName(front))
    links = tree.where("parent is not null").select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"))
    extra = u.where("src < dst").toDF("a", "b").join(links, ["a", "b"], "left_anti")
    mark = extra.select(F.explode(F.array("a", "b")).alias("node"), F.xxhash64(F.lit("edge"), "a", "b").alias("h")).groupBy("node").agg(
        F.bit_xor("h").alias("x"))
    own = cut(tree.join(mark, "node", "left").select("node", "parent", "level", F.coalesce("x", F.lit(0).cast("long")).alias("x")))
    done = own.where(F.col("level") == level)
    total = done
    for lv in range(level - 1, -1, -1):
        up = done.groupBy(F.col("parent").alias("node")).agg(F.bit_xor("x").alias("y"))
        done = cut(own.where(F.col("level") == lv).join(up, "node", "left").select(
            "node", "parent", "level", F.col("x").bitwiseXOR(F.coalesce("y", F.lit(0).cast("long"))).alias("x")))
        total = total.unionByName(done)
    return total.where("parent is not null and x = 0").select(F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"))


def average_path_length(edges: DataFrame, precision: int = 12, max_hops: int = 10_000) -> DataFrame:
    """Mean distance over all pairs of the largest component, from its neighbourhood function.

    Each node carries a sketch of the nodes within h hops; a round unites it with its neighbours' sketches, until none grows.
    ``precision`` is the sketches' log size: counts are exact while small and within about 1.04 / sqrt(2 ** precision) after.
    """
    comp = cut(components(edges))
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("k"))
    best = sizes.where("k > 1").orderBy(F.desc("k"), "component").limit(1)
    members = comp.join(best, "component", "left_semi").select("node")
    inside = cut(undirected(edges).join(members.withColumnRenamed("node", "src"), "src", "left_semi"))
    reach = cut(members.groupBy("node").agg(F.hll_sketch_agg("node", F.lit(precision)).alias("s")))
    pairs = lambda df: df.agg(F.sum(F.hll_sketch_estimate("s"))).first()[0] or 0
    counts = [pairs(reach)]
    for _ in range(max_hops):
        near = inside.join(reach.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "s").unionByName(reach)
        reach = cut(near.groupBy("node").agg(F.hll_union_agg("s").alias("s")))
        counts.append(pairs(reach))
        if counts[-1] <= counts[-2]:
            break
    else:
        raise RuntimeError(f"the largest component is wider than {max_hops} hops")
    total = sum(h * (b - a) for h, (a, b) in enumerate(zip(counts, counts[1:]), 1))
    mean = total / (counts[-1] - counts[0]) if counts[-1] > counts[0] else None
    return edges.sparkSession.range(1).select(F.round(F.lit(mean).cast("double"), 3).alias("avg_path_length"))


def random_walks(edges: DataFrame, per_node: int = 2, length: int = 8, seed: int = 42) -> DataFrame:
    """(walk, step, node): neighbours are numbered and each step picks one by a hash of (walk, step).

    Edges and the numbers of ways out of and into each node are written once, since every step reads them.
    """
    e = cut(edges.select("src", "dst").distinct())
    out = _numbered(e)
    back = _numbered(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ways = cut(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
               .join(_degree(out, "ko"), "node", "left").join(_degree(back, "kb"), "node", "left"))
    cur = cut(ways.select(F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("w"), "node").select(
        F.concat_ws("#", "node", "w").alias("walk"), "node"))
    steps = cur.select("walk", F.lit(0).alias("step"), "node")
    for s in range(1, length):
        h = F.xxhash64("walk", F.lit(s), F.lit(seed))
        at = cur.withColumn("h", h).join(ways, "node")
        fwd = F.col("ko").isNotNull()
        turn = F.col("ko").isNull() & F.col("kb").isNotNull() & (F.pmod(F.shiftright("h", 8), F.lit(2)) == 0)
        a = at.where(fwd).select("walk", F.col("node").alias("src"), F.pmod("h", F.col("ko")).alias("pos")).join(out, ["src", "pos"])
        b = at.where(turn).select("walk", F.col("node").alias("src"), F.pmod("h", F.col("kb")).alias("pos")).join(back, ["src", "pos"])
        cur = cut(a.unionByName(b).select("walk", F.col("dst").alias("node")))
        steps = steps.unionByName(cur.select("walk", F.lit(s).alias("step"), "node"))
    return steps


def _numbered(e: DataFrame) -> DataFrame:
    """Neighbours numbered from zero; counted in hash buckets so a hub is never one window group."""
    b = e.withColumn("hb", F.pmod(F.xxhash64("dst"), F.lit(4096)))
    return cut(with_position(b, ["src"], "dst", ts="hb", width=64).select("src", "pos", "dst"))


def _degree(numbered: DataFrame, out: str) -> DataFrame:
    return numbered.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias(out))


def embedding(walks: DataFrame, dim: int = 16, window: int = 5) -> DataFrame:
    """(node, e0..): random projection of log co-occurrence counts within the walk window.

    Every context node contributes a fixed +1/-1 vector taken from its hash, so no vocabulary or weight
    matrix is ever gathered.
    """
    # window pairs of one walk; a walk has at most `length` steps
    a = walks.select("walk", "step", F.col("node").alias("x"))
    b = walks.select("walk", F.col("step").alias("t"), F.col("node").alias("ctx"))
    pairs = a.join(b, "walk").where(F.expr(f"step <> t and abs(step - t) <= {window} and x <> ctx"))
    co = pairs.groupBy("x", "ctx").agg(F.log1p(F.count(F.lit(1))).alias("w"))
    bits = F.xxhash64("ctx", F.lit("axis"))
    vec = [F.sum(F.col("w") * F.when(F.expr(f"(shiftright(h, {i}) & 1) = 1"), 1.0).otherwise(-1.0)).alias(f"e{i}") for i in range(dim)]
    raw = co.withColumn("h", bits).groupBy(F.col("x").alias("node")).agg(*vec)
    norm = F.sqrt(reduce(lambda p, q: p + q, [F.col(f"e{i}") * F.col(f"e{i}") for i in range(dim)]))
    return raw.select("node", *[(F.col(f"e{i}") / F.when(norm == 0, 1.0).otherwise(norm)).alias(f"e{i}") for i in range(dim)])


def graph_score(features: DataFrame, cols: list[str], key: str = "account_no") -> DataFrame:
    """0-100: log, z clipped to 0-6, root of the mean share, min-max scaled."""
    logs = features.select(key, *[F.log1p(F.abs(F.col(c).cast("double"))).alias(c) for c in cols])
    stats = logs.agg(*[f(c).alias(f"{p}_{c}") for c in cols for p, f in (("m", F.avg), ("s", F.stddev_pop))])
    s = F.col("scalars")
    z = [F.least(F.greatest((F.col(c) - s[f"m_{c}"]) / F.when(s[f"s_{c}"] == 0, 1.0).otherwise(s[f"s_{c}"]), F.lit(0.0)), F.lit(6.0)) for c in cols]
    raw = with_scalars(logs, stats).select(key, F.sqrt(reduce(lambda a, b: a + b, z) / len(cols) / 6.0).alias("raw"))
    ends = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    span = s["hi"] - s["lo"]
    return with_scalars(raw, ends).select(key, F.when(span > 0, F.round((F.col("raw") - s["lo"]) / span * 100.0, 2)).otherwise(0.0).alias("graph_score"))


# ---------------------------------------------------------------- layers around a phone

def _top(rows: DataFrame, key: str, member: str, k: int) -> DataFrame:
    g = rows.where(F.col(key).isNotNull() & F.col(member).isNotNull()).groupBy(key, member).agg(F.count(F.lit(1)).alias("records"))
    w = W.partitionBy(key).orderBy(F.desc("records"), member)
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def identifier_layer(rows: DataFrame, phone: str, ident: str, per_phone: int = 6, per_ident: int = 8) -> DataFrame:
    """(phone, identifier, peer): a phone's most used identifiers and the phones that share each most."""
    mine = _top(rows, phone, ident, per_phone).select(F.col(phone).alias("phone"), F.col(ident).alias("identifier"),
                                                      F.col("records").alias("own_records"))
    # one more peer than shown, since the phone itself may be among them
    peers = _top(rows, ident, phone, per_ident + 1).select(F.col(ident).alias("identifier"), F.col(phone).alias("peer"),
                                                           F.col("records").alias("peer_records"), "rank")
    w = W.partitionBy("phone", "identifier").orderBy("rank")
    return (mine.join(peers, "identifier").where("peer <> phone").withColumn("n", F.row_number().over(w))
            .where(F.col("n") <= per_ident).select("phone", "identifier", "own_records", "peer", "peer_records", "n"))


def device_layer(cdr: DataFrame) -> DataFrame:
    return identifier_layer(cdr, "a_number", "imei")


def ip_layer(ipdr: DataFrame) -> DataFrame:
    return identifier_layer(ipdr, "msisdn", "source_ip")


def hubs(edges: DataFrame, between: DataFrame | None = None, community: DataFrame | None = None, top: int = 25) -> DataFrame:
    d = degrees(edges).select("node", "degree", "in_degree", "out_degree")
    d = d.join(between, "node", "left") if between is not None else d.withColumn("betweenness", F.lit(0.0))
    d = d.join(community.select("node", "community"), "node", "left") if community is not None else d.withColumn("community", F.lit(None).cast("string"))
    return d.orderBy(F.desc("degree"), F.desc("betweenness"), "node").limit(top)
