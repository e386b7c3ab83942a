"""Exact nearest neighbours by pivots: every row is compared only with parts that can hold one of its neighbours.

Rows with the same values are one point with a weight, so crowds of equal rows are never paired. The points are dealt to
the nearest of about the square root of their number of pivots, and neighbouring cells are joined to parts of bounded size; a
large cell has several. A point first meets the part it lies in, which bounds its k-th distance from above; the triangle
inequality bounds its distance to a cell from below; the point is then sent only to parts where the lower bound does not exceed
the upper one. Inside a part, distances from one product of matrices choose candidates, with room for its rounding, and the
candidates' distances are taken by differences.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.session import cut, ship_package

#: Points of a part at most, queries that meet a part in one task, and cells of a matrix of distances.
PART, CHUNK, TILE = 16_384, 16_384, 4_000_000


def points(x: DataFrame, cols: Sequence[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(id, v, w): distinct value vectors, named by their smallest key and weighted by their rows; and (key, id)."""
    rows = cut(x.select(F.col(key).cast("string").alias("key"), F.array(*[F.col(c).cast("double") for c in cols]).alias("v")))
    named = cut(rows.groupBy("v").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("w")))
    return named, rows.join(named, "v").select("key", "id")


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), float)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By differences: from products of the vectors, near copies far from the origin would come out apart."""
    sq = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T):
        sq += np.subtract.outer(x, y) ** 2
    return np.sqrt(sq)


def _limits(limit: np.ndarray) -> np.ndarray:
    """Room for rounding of bounds that are made from distances to pivots."""
    return limit * (1 + 1e-9) + 1e-7


def parts_of(pivots: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First part and number of parts of each cell, along a chain of nearest pivots; no part is expected to hold more than ``most``."""
    first, count = np.zeros(len(pivots), int), np.maximum(1, -(-sizes // most)).astype(int)
    left, at, part, load = np.ones(len(pivots), bool), 0, 0, 0
    for _ in range(len(pivots)):
        if load and load + sizes[at] > most:
            part, load = part + 1, 0
        first[at], load, left[at] = part, load + sizes[at], False
        if count[at] > 1:
            part, load = part + count[at], 0
        if left.any():
            at = int(np.where(left, ((pivots - pivots[at]) ** 2).sum(1), np.inf).argmin())
    return first, count


def best_in_part(x: np.ndarray, names: np.ndarray, limit: np.ndarray, y: np.ndarray, others: np.ndarray, weight: np.ndarray, k: int) -> Iterator[tuple]:
    """(row of x, row of y, distance, weight) of what may be among each row's nearest: within its limit, until weights reach ``k``."""
    centre = y.mean(0)
    u, z = x - centre, y - centre
    nu, nz = (u * u).sum(1), (z * z).sum(1)
    slack = 64 * np.finfo(float).eps * (x.shape[1] + 8) * (nu + nz.max())
    left, right = np.column_stack([-2 * u, nu, np.ones(len(u))]), np.column_stack([z, np.ones(len(z)), nz]).T.copy()
    limit = _limits(limit)
    rank = np.empty(len(others), int)
    rank[np.argsort(np.array([o or "" for o in others], object), kind="stable")] = np.arange(len(others))
    step = max(1, TILE // len(y))
    for at in range(0, len(x), step):
        near, top = left[at:at + step] @ right, limit[at:at + step] ** 2
        open_ended = np.flatnonzero(~np.isfinite(top))
        if len(open_ended) and len(y) > k + 1:  # k others and the row itself
            top[open_ended] = np.partition(near[open_ended], k, axis=1)[:, k] + slack[at + open_ended]
        i, j = np.nonzero(near <= (top + slack[at:at + step])[:, None])
        i += at
        sq = np.zeros(len(i))  # by differences: from products of the vectors, near copies far from the origin would come out apart
        for a, b in zip(x.T, y.T):
            sq += (a[i] - b[j]) ** 2
        own = names[i] == others[j]
        dist, w = np.where(own, 0.0, np.sqrt(sq)), weight[j] - own
        use = (dist <= limit[i]) & (w > 0)
        i, j, dist, w = i[use], j[use], dist[use], w[use]
        order = np.lexsort((rank[j], dist, i))
        i, j, dist, w = i[order], j[order], dist[order], w[order]
        before = np.cumsum(w) - w
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
        before -= np.repeat(before[starts], np.diff(np.r_[starts, len(i)]))
        use = before < k
        yield i[use], j[use], dist[use], w[use]


def nearest(queries: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(id, other, dist, take) for each query: members in order of distance until their weights reach ``k``; ``take`` is the weight counted.

    Both sides are (id, v, w). A query that is itself a member counts its other copies, at distance 0. Ties go by id.
    """
    ship_package(members.sparkSession)
    context = members.sparkSession.sparkContext
    n = members.count()
    if n == 0:
        return queries.select("id", F.col("id").alias("other"), F.lit(0.0).alias("dist"), F.lit(0).cast("long").alias("take")).limit(0)
    chosen = members.orderBy(F.xxhash64("id"), "id").limit(int(np.ceil(np.sqrt(n)))).select("v").toPandas()
    pivots = context.broadcast(_matrix(chosen["v"]))
    row = "id string, b binary, w long, h long"
    hashed = lambda df: df.select("id", "v", "w", F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("h"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = _matrix(batch["v"])
            d = distances(v, pivots.value)
            yield pd.DataFrame({"id": batch["id"], "b": _packed(v), "w": batch["w"], "h": batch["h"], "cell": d.argmin(1), "r": d.min(1)})

    dealt = cut(hashed(members).mapInPandas(deal, f"{row}, cell int, r double"))
    spans = dealt.groupBy("cell").agg(F.max("r").alias("far"), F.count(F.lit(1)).alias("size")).toPandas().set_index("cell").reindex(range(len(chosen)))
    most = min(PART, max(1024, n // 32))  # enough parts for many tasks
    first, count = parts_of(pivots.value, spans["size"].fillna(0).to_numpy(int), most)
    shape = context.broadcast((spans["far"].fillna(-np.inf).to_numpy(float), first, count))
    parts = int((first + count).max())

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, first, count = shape.value
        for batch in batches:
            cell = batch["cell"].to_numpy()
            yield batch.drop(columns=["cell", "r"]).assign(part=first[cell] + batch["h"].to_numpy() % count[cell])

    placed = cut(dealt.mapInPandas(place, f"{row}, part int"))
    asked = cut(hashed(queries).mapInPandas(lambda batches: place(deal(batches)), f"{row}, part int").withColumn("limit", F.lit(float("inf"))))
    found = _met(asked, placed, asked.groupBy("part").agg(F.count(F.lit(1)).alias("n")), k)
    if parts > 1:
        found = cut(found)
        reached = found.groupBy("id").agg(F.max("dist").alias("far"), F.sum("w").alias("n")).where(F.col("n") >= k).select("id", "far")
        known = cut(asked.drop("limit").join(reached, "id", "left").withColumn("limit", F.coalesce("far", F.lit(float("inf")))).drop("far"))

        def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
            p, (far, first, count) = pivots.value, shape.value
            apart = distances(p, p)
            cells = np.repeat(np.arange(len(p)), count)
            in_part = np.concatenate([np.arange(f, f + c) for f, c in zip(first, count)])
            cells, in_part = cells[np.argsort(in_part, kind="stable")], np.sort(in_part)
            starts = np.flatnonzero(np.r_[True, in_part[1:] != in_part[:-1]])
            for whole in batches:
                for at in range(0, len(whole), 1024):
                    batch = whole.iloc[at:at + 1024]
                    d = distances(_unpacked(batch["b"]), p)
                    own = d.argmin(1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        beyond = (d ** 2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * apart[own])
                    low = np.maximum(d - far, np.where(apart[own] > 0, beyond, 0.0))
                    low = np.minimum.reduceat(low[:, cells], starts, axis=1)
                    go = ~(low > _limits(batch["limit"].to_numpy())[:, None])
                    go[np.arange(len(go)), batch["part"].to_numpy()] = False
                    yield batch, go

        def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = sum((go.sum(0) for _, go in wanted(batches)), np.zeros(parts, int))
            yield pd.DataFrame({"part": np.flatnonzero(total), "n": total[total > 0]})

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch, go in wanted(batches):
                i, part = np.nonzero(go)
                yield batch.iloc[i].assign(part=part)

        asks = known.mapInPandas(sizes, "part int, n long").groupBy("part").agg(F.sum("n").alias("n"))
        found = found.unionByName(_met(known.mapInPandas(send, known.schema), placed, asks, k))
    before = F.coalesce(F.sum("w").over(W.partitionBy("id").orderBy("dist", "other").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("take", F.least(F.col("w"), F.lit(k) - before)).where("take > 0").select("id", "other", "dist", "take")


def _packed(v: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(v)]


def _unpacked(b: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(b), float).reshape(len(b), -1)


def _met(asked: DataFrame, placed: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """(id, other, dist, w) of the members of each part that may be among the nearest of the queries ``asked`` of it.

    Queries of a part are dealt to tasks of about ``CHUNK``, to each of which the part's members go.
    """
    n = asks.toPandas()
    chunks = dict(zip(n["part"].tolist(), (-(-n["n"] // CHUNK)).tolist()))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns=["w", "h"]).assign(q=(batch["h"].to_numpy() >> 20) % batch["part"].map(chunks).to_numpy(int))

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            times = batch["part"].map(chunks).fillna(0).to_numpy(int)
            rows = np.repeat(np.arange(len(batch)), times)
            yield batch.drop(columns="h").iloc[rows].assign(q=np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int))]
        names, others = a["id"].to_numpy(object), b["id"].to_numpy(object)
        if len(a) and len(b):
            found += best_in_part(_unpacked(a["b"]), names, a["limit"].to_numpy(), _unpacked(b["b"]), others, b["w"].to_numpy(), k)
        i, j, dist, w = map(np.concatenate, zip(*found))
        return pd.DataFrame({"id": names[i], "other": others[j], "dist": dist, "w": w})

    # both sides need keys of one type, or equal ones are sent to different tasks
    left = asked.mapInPandas(deal, "id string, b binary, part int, limit double, q int").groupBy("part", "q")
    right = placed.mapInPandas(copy, "id string, b binary, w long, part int, q int").groupBy("part", "q")
    return left.cogroup(right).applyInPandas(compare, "id string, other string, dist double, w long")


def neighbour_scores(x: DataFrame, cols: Sequence[str], kind: str, key: str = "account_no", k: int = 20, eps: float = 1.5, min_samples: int = 5, out: str = "score") -> DataFrame:
    """Neighbour-based scores of every row against all others.

    ``kind`` is one of ``lof`` (local outlier factor), ``dbscan`` (noise, scored by nearness to a core row), ``core``
    (distance of the k-th neighbour) and ``knn`` (mean distance of the k nearest).
    """
    named, keys = points(x, cols, key)
    rows = named.agg(F.sum("w")).first()[0] or 0
    k = max(1, min(k, rows - 1))
    mean = lambda c: F.sum(c * F.col("take")) / F.sum("take")
    if kind == "dbscan":
        wide = nearest(named, named, max(1, min_samples - 1)).groupBy("id").agg(F.max("dist").alias("dk"), F.sum("take").alias("n"))
        core = cut(named.join(wide, "id", "left").select("id", "v", "w", F.coalesce((F.col("dk") <= eps) & (F.col("n") >= min_samples - 1), F.lit(min_samples <= 1)).alias("core")))
        hit = nearest(core.where("not core").select("id", "v", "w"), core.where("core").select("id", "v", "w"), 1).groupBy("id").agg(F.min("dist").alias("to_core"))
        raw = F.when(F.col("core"), 0.0).when(F.col("to_core").isNull(), 3.0).when(F.col("to_core") > eps, F.greatest(F.lit(0.0), 3.0 - F.col("to_core"))).otherwise(0.0)
        scored = core.join(hit, "id", "left").select("id", raw.alias(out))
    else:
        near = cut(nearest(named, named, k))
        if kind in ("core", "knn"):
            scored = near.groupBy("id").agg((F.max("dist") if kind == "core" else mean(F.col("dist"))).alias(out))
        else:
            kth = near.groupBy("id").agg(F.max("dist").alias("kdist"))
            reach = near.join(kth.withColumnRenamed("id", "other"), "other").groupBy("id").agg((1.0 / (mean(F.greatest("kdist", "dist")) + 1e-10)).alias("lrd"))
            reach = cut(reach)
            around = near.join(reach.withColumnRenamed("id", "other"), "other").groupBy("id").agg(mean(F.col("lrd")).alias("others"))
            scored = around.join(reach, "id").select("id", (F.col("others") / F.col("lrd")).alias(out))
    return keys.join(scored, "id", "left").select(F.col("key").alias(key), F.coalesce(out, F.lit(0.0)).alias(out))
