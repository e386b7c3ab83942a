"""Hard negatives by exact search in an inverted multi-index of integer vectors.

Two codebooks, one for each half of the components, form cells. For an anchor, a cell's rows score at most the sum of two half
bounds: the product with the half's centre plus the anchor's norm times the centre's radius. A heap visits the cells of the two
sorted lists by that sum; a search ends once no cell to come can change what it has found. Searches run in rounds: each lets every
open anchor visit further cells, scores blocks of anchors against blocks of rows, and keeps the few best for each anchor.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import discard, python_ready, stored, with_totals
from weftline.llm.vectors import floored, matrix, sound, usual_length

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Bounds of a negative's score in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Centres of each half codebook and rows that they are fitted on (those with the smallest hashes).
CENTRES, SAMPLE, ITERATIONS = 16, 4096, 8
#: Rows of a block, anchors of a block, rows that an anchor's first round may visit, and the growth of that number.
ROWS, ANCHORS, BUDGET, GROWTH = 4096, 256, 16384, 8
#: Stands for a null vec_id, which comes last.
LAST = (1 << 63) - 1


class Index(NamedTuple):
    """Half codebooks with radii, and rows of each cell; at most CENTRES squared cells, so it fits every task."""

    centres: np.ndarray  # (half, centre, component)
    radii: np.ndarray  # (half, centre)
    sizes: np.ndarray  # (centre, centre)
    first: np.ndarray  # (centre, centre): first block of anchors, and how many blocks it has
    spread: np.ndarray


def halves(x: np.ndarray) -> np.ndarray:
    """(half, row, component); the second half is filled up with a zero when the number of components is odd."""
    m = (x.shape[1] + 1) // 2
    return np.stack([x[:, :m], np.pad(x[:, m:], ((0, 0), (0, 2 * m - x.shape[1])))]).astype(np.float64)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre of each row and its exact distance."""
    at = ((centres ** 2).sum(1) - 2 * x @ centres.T).argmin(1)
    return at, np.sqrt(((x - centres[at]) ** 2).sum(1))


def fitted(sample: np.ndarray, centres: int) -> np.ndarray:
    """Half codebooks by Lloyd rounds on the sample, started from rows spread over it."""
    out = []
    for x in halves(sample):
        own = np.unique(x, axis=0)
        now = own[np.linspace(0, len(own) - 1, min(centres, len(own))).astype(int)]
        for _ in range(ITERATIONS):
            at, _d = nearest(x, now)
            now = np.stack([x[at == k].mean(0) if (at == k).any() else now[k] for k in range(len(now))])
        out.append(now)
    k = min(len(c) for c in out)
    return np.stack([c[:k] for c in out])


def half_bounds(x: np.ndarray, index: Index) -> np.ndarray:
    """(half, row, centre): the greatest score that any row of a centre can have in that half, rounding covered."""
    h = halves(x)
    norms = np.sqrt((h ** 2).sum(2))
    bound = np.einsum("hnm,hkm->hnk", h, index.centres) + norms[:, :, None] * index.radii[:, None, :]
    return bound + 1e-9 * (np.abs(bound) + norms[:, :, None] * np.sqrt((index.centres ** 2).sum(2))[:, None, :]) + 1e-6


def visits(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, first centre, second centre) of the cells that have rows, by falling sum of half bounds: multi-sequence heap."""
    a, b = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    heap = [(-(left[a[0]] + right[b[0]]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        if sizes[a[i], b[j]]:
            yield -bound, int(a[i]), int(b[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (-(left[a[i]] + right[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(left[a[i + 1]] + right[b[0]]), i + 1, 0))


def planned(searches: DataFrame, index: Index, width: int, budget: int) -> DataFrame:
    """Each open search with ``cells`` to visit next, ``visited`` moved on, and ``bound`` of all that stays unvisited (null: none).

    A search walks anew from the start each round; the order is the same, so ``visited`` cells are skipped.
    """
    cells, fields = index.sizes.shape[1], [f for f in searches.schema.fields if f.name not in ("visited", "bound", "cells")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            bounds = half_bounds(matrix(batch.column("x"), width), index)
            visited, floor = batch.column("visited").to_pylist(), batch.column("floor").to_pylist()
            to, nexts, seen = [], [], []
            for n in range(len(batch)):
                found, rows, after, at = [], 0, None, 0
                for at, (bound, i, j) in enumerate(visits(bounds[0, n], bounds[1, n], index.sizes)):
                    if at < visited[n]:
                        continue
                    if rows >= budget or (floor[n] is not None and bound < floor[n]):
                        after = bound
                        break
                    found.append(i * cells + j)
                    rows += int(index.sizes[i, j])
                to.append(found)
                seen.append(visited[n] + len(found))
                nexts.append(after)
            kept = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seen, pa.int64()), pa.array(nexts, pa.float64()), pa.array(to, pa.list_(pa.int64()))], names=[*[f.name for f in fields], "visited", "bound", "cells"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return searches.mapInArrow(run, f"{schema}, visited long, bound double, cells array<long>")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; floating point where every sum stays below 2^53."""
    size = lambda m: max(-int(m.min()), int(m.max())) if m.size else 0
    if size(a) * size(b) * a.shape[1] < 1 << 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a @ b.T


FOUND = "key long, slot int, other long, score long"
#: Rows that a task gathers before it keeps the best of each slot, and passes them on if too many are left.
GATHERED = 200_000


def foremost(found: list[np.ndarray], most: int) -> list[np.ndarray]:
    """The ``most`` best rows of each (key, slot), by falling score, then smaller id."""
    key, slot, other, score = found
    order = np.lexsort((other, -score, slot, key))
    key, slot = key[order], slot[order]
    start = np.concatenate([[True], (key[1:] != key[:-1]) | (slot[1:] != slot[:-1])])
    first = np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))
    kept = order[np.arange(len(key)) - first < most]
    return [c[kept] for c in found]


def scored(pairs: DataFrame, width: int, same: bool, most: int) -> DataFrame:
    """(key, slot, other, score): the ``most`` best rows of a block for each window of each anchor of a block.

    A task keeps only the best of what all its blocks have for a slot. Windows lie in ``low`` and ``high``; ``same`` asks for rows of the anchor's label, else for other labels. Rows of the anchor's own
    id never count. Ties go to the smaller id, by which the rows of a block are sorted.
    """

    def packed(found: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, found)], names=["key", "slot", "other", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for r in range(len(batch)):
                anchors, rows = (batch.column(c)[r].values for c in ("anchors", "rows"))
                ids, labels, x = (rows.field(c) for c in ("vec_id", "label", "x"))
                ids, labels, x = ids.to_numpy(), labels.to_numpy(), matrix(x, width)
                order = np.argsort(ids, kind="stable")
                ids, labels, x = ids[order], labels[order], x[order]
                keys, own, kind = (anchors.field(c).to_numpy() for c in ("key", "vec_id", "label"))
                score = products(matrix(anchors.field("x"), width), x)
                fits = (labels[None, :] == kind[:, None]) == same
                fits &= ids[None, :] != own[:, None]
                low, high = anchors.field("low").to_pylist(), anchors.field("high").to_pylist()
                for slot in range(max(map(len, low), default=0)):
                    has = np.array([n for n in range(len(own)) if slot < len(low[n])])
                    least, greatest = (np.array([v[n][slot] for n in has])[:, None] for v in (low, high))
                    here = score[has]
                    left = fits[has] & (here >= least) & (here <= greatest)
                    for _ in range(min(most, len(ids))):
                        value = np.where(left, here, -np.inf if here.dtype.kind == "f" else -LAST)
                        k = value.argmax(1)
                        n = np.nonzero(left[np.arange(len(has)), k])[0]
                        if not len(n):
                            break
                        out.append((keys[has[n]], np.full(len(n), slot, np.int32), ids[k[n]], here[n, k[n]].astype(np.int64)))
                        left[n, k[n]] = False
                        size += len(n)
                if size > GATHERED:
                    best_rows = foremost([np.concatenate(c) for c in zip(*out)], most)
                    out, size = [tuple(best_rows)], len(best_rows[0])
                    if size > GATHERED // 2:
                        yield packed(best_rows)
                        out, size = [], 0
        if out:
            yield packed(foremost([np.concatenate(c) for c in zip(*out)], most))

    return pairs.mapInArrow(run, FOUND)


def best(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` best of each anchor's slot; a pair that was seen twice counts once."""
    order = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "other")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def searched(searches: DataFrame, blocks: DataFrame, index: Index, width: int, same: bool, most: int) -> DataFrame:
    """The ``most`` best rows (key, slot, other, score, rank) for each window of each search, exact.

    ``searches``: key, vec_id, label, x, block, low, high, want (rows that each slot can have at most), floor (score under which nothing
    counts). A search stays open while a slot has fewer rows than it wants or its last row does not score above all unvisited cells.
    """
    open_ = stored(searches.select("key", "vec_id", "label", "x", "block", "low", "high", "want", "floor", F.lit(0).cast("long").alias("visited"), F.lit(None).cast("double").alias("bound")))
    groups = stored(open_.groupBy("block").agg(F.collect_list(F.struct("key", "vec_id", "label", "x", "low", "high")).alias("anchors")))
    per_cell = F.from_json(F.lit(str([int(-(-n // ROWS)) for n in index.sizes.reshape(-1)])), "array<int>")
    found, budget = None, BUDGET
    while open_ is not None:
        walked = stored(planned(open_, index, width, budget))
        asked = walked.select("block", F.explode("cells").alias("cell")).distinct()
        asked = asked.select("block", "cell", F.explode(F.sequence(F.lit(0), F.element_at(per_cell, (F.col("cell") + 1).cast("int")) - 1)).alias("part"))
        pairs = asked.join(groups, "block").join(blocks, ["cell", "part"]).select("anchors", "rows")
        new = scored(pairs, width, same, most)
        seen = new if found is None else new.unionByName(found.select("key", "slot", "other", "score"))
        old, found = found, stored(best(seen, most))
        if old is not None:
            discard(old)
        slots = found.groupBy("key", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        state = walked.select("key", "bound", "want", F.posexplode("low").alias("slot", "low")).where("bound IS NOT NULL")
        unsure = state.join(slots, ["key", "slot"], "left").where((F.coalesce("n", F.lit(0)) < F.col("want")) & (F.col("bound") >= F.col("low")) | (F.col("n") >= F.col("want")) & (F.col("bound") >= F.col("least")))
        going = stored(walked.drop("cells").join(unsure.select("key").distinct(), "key", "left_semi"))
        discard(open_)
        discard(walked)
        open_, budget = (going, budget * GROWTH) if going.limit(1).count() else (None, 0)
        if open_ is None:
            discard(going)
    return found


def indexed(rows: DataFrame, anchor: Column, width: int) -> tuple[DataFrame, DataFrame, Index]:
    """Blocks of rows (cell, part, rows), anchors with a key of their own and their block, and the index itself. Every row is indexed."""
    sample = np.array([r["x"] for r in rows.select("x").orderBy(F.xxhash64("vec_id", "x")).limit(SAMPLE).collect()], np.int64).reshape(-1, width)
    centres = fitted(sample, CENTRES)
    count = centres.shape[1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                at, far = zip(*[nearest(x, c) for x, c in zip(halves(matrix(batch.column("x"), width)), centres)])
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("vec_id", "label", "x")] + [pa.array(at[0] * count + at[1]), pa.array(far[0]), pa.array(far[1])], names=["vec_id", "label", "x", "cell", "far0", "far1"])

    each = stored(rows.select("vec_id", "label", "x").mapInArrow(placed, "vec_id long, label long, x array<long>, cell long, far0 double, far1 double"))
    table = each.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.when(anchor, 1).otherwise(0)).alias("anchors"), F.max("far0").alias("far0"), F.max("far1").alias("far1")).collect()
    sizes, radii, anchors = np.zeros(count * count, np.int64), np.zeros((2, count)), np.zeros(count * count, np.int64)
    for r in table:
        i, j = divmod(r["cell"], count)
        sizes[r["cell"]], anchors[r["cell"]] = r["n"], r["anchors"]
        radii[0, i], radii[1, j] = max(radii[0, i], r["far0"]), max(radii[1, j], r["far1"])
    spread = np.maximum(1, -(-anchors // ANCHORS))  # a cell with many anchors has blocks of its own, small ones share
    shared = np.where(spread == 1, anchors, 0)
    first = np.where(spread == 1, np.cumsum(shared) // ANCHORS, 0)
    first = np.where(spread > 1, first.max(initial=0) + 1 + np.cumsum(np.where(spread > 1, spread, 0)) - spread, first)
    index = Index(centres, radii * (1 + 1e-9), sizes.reshape(count, count), first, spread)
    value = lambda numbers: F.element_at(F.from_json(F.lit(str([int(v) for v in numbers])), "array<int>"), (F.col("cell") + 1).cast("int"))
    part = lambda numbers: F.pmod(F.xxhash64("vec_id", "label"), value(numbers)).cast("int")
    blocks = stored(each.groupBy("cell", part(-(-np.maximum(sizes, 1) // ROWS)).alias("part")).agg(F.collect_list(F.struct("vec_id", "label", "x")).alias("rows")))
    started = stored(each.where(anchor).select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", "x", (value(first) + part(spread)).alias("block")))
    discard(each)
    return blocks, started, index


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact.

    ``vectors``: vec_id, label, x (integers, one length). Anchors are the rows with the condition ``anchor`` on vec_id. A score is an inner
    product; higher ones come first, ties by smaller vec_id. Each anchor has its first ``positives`` other rows of its label, and for
    each of them the first ``negatives`` rows of other labels with low * positive <= 100 * negative <= high * positive.
    Rows with a null label or vector take no part. A row is told by its vec_id: exact repeats count once, and no row of the anchor's id is
    its positive or negative. Null ids come last and are no anchors. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    python_ready(spark)
    rows = vectors.where("label IS NOT NULL AND x IS NOT NULL").select(F.coalesce("vec_id", F.lit(LAST)).alias("vec_id"), F.col("label").cast("long").alias("label"), "x").distinct()
    # among equal vectors of a label only the first few ids can ever be returned
    first = F.row_number().over(Window.partitionBy("x", "label").orderBy("vec_id"))
    is_anchor = anchor & (F.col("vec_id") != LAST)
    rows = stored(rows.withColumn("_n", first).where((F.col("_n") <= max(positives + 1, negatives)) | is_anchor).drop("_n"))
    width = usual_length(rows, "x")
    if width is None:
        return rows.select(F.col("vec_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.lit(0).alias("rank"), F.col("vec_id").alias("negative_id"), F.col("vec_id").alias("positive_score"), F.col("vec_id").alias("negative_score"))
    rows = rows.where(F.size("x") == width)
    blocks, anchors, index = indexed(rows, is_anchor, width)
    have = rows.groupBy("label").agg(F.count("*").alias("n"))
    everything = lambda value: F.array(F.lit(value).cast("long"))
    started = with_totals(anchors, have, "label", F.xxhash64("vec_id")).select("key", "vec_id", "label", "x", "block", everything(-LAST).alias("low"), everything(LAST).alias("high"),
                                                                            F.least(F.lit(positives), F.col("n") - 1).cast("int").alias("want"), F.lit(None).cast("double").alias("floor")).where("want > 0")
    near = searched(started, blocks, index, width, True, positives)
    down = lambda value: F.expr(f"({value}) div 100 + if(({value}) % 100 < 0, -1, 0)")
    least, greatest = -down(f"-{low} * score"), down(f"{high} * score")
    windows = near.select("key", F.col("rank").alias("place"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"), least.alias("least"), greatest.alias("greatest")).where("least <= greatest")
    each = stored(windows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score", "least", "greatest"))).alias("w")))
    asked = anchors.join(each, "key").select("key", "vec_id", "label", "x", "block", F.col("w.least").alias("low"), F.col("w.greatest").alias("high"), F.lit(negatives).alias("want"), F.array_min("w.least").cast("double").alias("floor"))
    far = searched(asked, blocks, index, width, False, negatives)
    named = each.join(anchors.select("key", "vec_id"), "key").select("key", "vec_id", F.posexplode("w").alias("slot", "p"))
    real = lambda c: F.nullif(F.col(c), F.lit(LAST))
    return named.join(far, ["key", "slot"]).select(F.col("vec_id").alias("anchor_id"), real("p.positive_id").alias("positive_id"), "rank", real("other").alias("negative_id"), F.col("p.positive_score").alias("positive_score"), F.col("score").alias("negative_score"))


def negative_report(vectors: DataFrame) -> DataFrame:
    """The contract's anchors and labels; rows with a null or non-finite component take no part, nor rows of an unusual length."""
    kept = vectors.select("vec_id", "label", "embedding").where(F.col("label").isNotNull() & sound("embedding"))
    width = usual_length(kept, "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(kept.where(F.size("embedding") == (width or 0)).select("vec_id", label.alias("label"), floored("embedding", SCALE).alias("x")), F.col("vec_id") % 50 == 0)
