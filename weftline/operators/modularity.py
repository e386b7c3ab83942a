"""Communities by greedy modularity: best gains first, many merges a round, edges contracted after each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.graphs import undirected
from weftline.session import cut

EXACT = "decimal(18,0)"


def modularity_communities(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, community, community_size) where no merge of two linked communities would raise modularity.

    Gains are whole numbers, 2m * links - degree * degree, so nothing depends on summation order. Each round every community picks
    the neighbour with the largest gain (ties: smallest pair of names). Two that pick each other merge, into the one with more
    ends, and the others that picked that one join it too if they gain even after all of them have joined; half of them are asked
    in a round, so a hub with any number of leaves is done in logarithmic rounds. A round therefore never lowers modularity, and
    the best pair of all always merges. Communities are named after one of their nodes; nodes with loops only stay alone.
    Raises when gains are left after ``max_rounds``.

    All steps are joins and aggregates over at most one row per linked pair of communities; only counts reach the driver.
    """
    e = edges.where("src is not null and dst is not null")
    nodes = cut(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    links = cut(undirected(e).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).cast(EXACT).alias("w")))
    ends = links.count()
    degree = links.groupBy(F.col("a").alias("c")).agg(F.count(F.lit(1)).cast(EXACT).alias("k"))
    groups, member = cut(degree), nodes.select("node", F.col("node").alias("c"))
    for turn in range(max_rounds):
        best = cut(_choices(links, groups, ends))
        if best.isEmpty():
            break
        merged = cut(_merges(best, ends, turn))
        into = lambda df, col: df.join(merged.toDF(col, "to"), col, "left").withColumn(col, F.coalesce("to", col)).drop("to")
        member = cut(into(member, "c"))
        groups = cut(into(groups, "c").groupBy("c").agg(F.sum("k").cast(EXACT).alias("k")))
        links = cut(into(into(links, "a"), "b").where("a <> b").groupBy("a", "b").agg(F.sum("w").cast(EXACT).alias("w")))
    else:
        raise RuntimeError(f"modularity still grows after {max_rounds} rounds")
    sizes = member.groupBy("c").agg(F.count(F.lit(1)).alias("community_size"))
    return member.join(sizes, "c").select("node", F.col("c").alias("community"), "community_size")


def _choices(links: DataFrame, groups: DataFrame, ends: int) -> DataFrame:
    """(a, b, w, ka, kb): for each community with a gain, the neighbour with the largest."""
    gain = F.lit(ends).cast(EXACT) * F.col("w") - F.col("ka") * F.col("kb")
    rows = links.join(groups.toDF("a", "ka"), "a").join(groups.toDF("b", "kb"), "b").withColumn("gain", gain).where("gain > 0")
    order = F.struct(-F.col("gain"), F.least("a", "b"), F.greatest("a", "b"))
    return rows.groupBy("a").agg(F.min_by(F.struct("b", "w", "ka", "kb"), order).alias("p")).select("a", "p.*")


def _merges(best: DataFrame, ends: int, turn: int) -> DataFrame:
    """(community, the one that it joins)."""
    back = best.select(F.col("a").alias("b"), F.col("b").alias("a"))
    mutual = best.join(back, ["a", "b"])
    heart = mutual.where("ka > kb or (ka = kb and a < b)").select(F.col("a").alias("b"), F.col("b").alias("partner"))
    asked = best.join(heart, "b").where(
        (F.col("a") == F.col("partner")) | (F.substring(F.md5(F.concat_ws("#", "a", F.lit(str(turn)))), 1, 1) < "8"))
    crowd = asked.groupBy("b").agg(F.sum("ka").cast(EXACT).alias("crowd"))
    after = (F.col("kb") + F.col("crowd") - F.col("ka")).cast(EXACT)
    joins = (F.col("a") == F.col("partner")) | (F.lit(ends).cast(EXACT) * F.col("w") > F.col("ka") * after)
    return asked.join(crowd, "b").where(joins).select("a", "b")
