"""Product-quantisation codes: Lloyd rounds on Spark with norm-of-sum bounds before exact rescans.

Every row keeps, for each part and group of codebook entries, a lower bound of the distance to the group's entries and the round in
which it was measured. All codebooks of earlier rounds are kept (a few kilobytes), so a bound is lowered by the true net displacement of
an entry since that round: the norm of the summed moves, never more than the sum of their norms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import discard, python_ready, stored, with_totals
from weftline.llm.vectors import floored, matrix, sound, usual_length

SCALE, PARTS, ENTRIES, ROUNDS, GROUP = 4096, 8, 16, 6, 4
#: Relative slack that covers rounding of square roots and of stored bounds.
SLACK = 1e-6


def prepared(vectors: DataFrame, parts: int, scale: int) -> tuple[DataFrame, int]:
    """Rows that take part (row, vec_id, label, x as integers), stored, and the number of components.

    Rows of another length than the commonest take no part.
    """
    kept = vectors.select("vec_id", "label", "embedding").where(sound("embedding"))
    width = usual_length(kept, "embedding") or 0
    if width % parts:
        raise ValueError(f"{width} components cannot be cut into {parts} equal parts")
    rows = kept.where(F.size("embedding") == width).select("vec_id", "label", floored("embedding", scale).alias("x"))
    return stored(rows), width


def first_codebooks(rows: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """(part, entry, component): the parts of the rows with the smallest ids; ties by components, null ids last."""
    found = rows.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    return np.array([r["x"] for r in found], np.int64).reshape(len(found), parts, width // parts).transpose(1, 0, 2)


def displacement(history: list[np.ndarray], group: int) -> np.ndarray:
    """(round, part, group): the farthest that an entry of the group has moved, net, from that round to the last."""
    now, starts = history[-1], np.arange(0, history[-1].shape[1], group)
    moved = [np.sqrt(((now - then).astype(np.float64) ** 2).sum(2)) for then in history]
    return np.stack([np.maximum.reduceat(m, starts, axis=1) for m in moved])


def assigned(x: np.ndarray, code: np.ndarray, bound: np.ndarray, stamp: np.ndarray, history: list[np.ndarray], group: int):
    """Nearest entries in the last codebook, ties to the lower index.

    ``x`` (row, part, component), ``code`` (row, part), ``bound`` and ``stamp`` (row, part, group); negative bounds know nothing.
    Returns code, bound, stamp, squared errors and the number of entry distances that were computed for each row.
    """
    now, t = history[-1], len(history) - 1
    parts, entries = now.shape[:2]
    which = np.arange(parts)[None, :]
    gone = displacement(history, group)
    lower = np.maximum(bound * (1 - SLACK) - gone[stamp, which[:, :, None], np.arange(bound.shape[2])[None, None, :]] * (1 + SLACK), -1.0)
    own = ((x - now[which, code]) ** 2).sum(2)
    open_ = lower <= np.sqrt(own)[:, :, None] * (1 + SLACK)
    best, best_code = own.copy(), code.copy()
    scans = np.full(len(x), parts, np.int64)
    measured: list[tuple] = []
    for g, start in enumerate(range(0, entries, group)):
        stop = min(start + group, entries)
        rows, ps = np.nonzero(open_[:, :, g])
        if not len(rows):
            continue
        d = ((x[rows, ps][:, None, :] - now[ps, start:stop]) ** 2).sum(2)
        scans += np.bincount(rows, minlength=len(x)) * (stop - start)
        measured.append((g, start, rows, ps, d))
        k = d.argmin(1)
        least = d[np.arange(len(d)), k]
        better = (least < best[rows, ps]) | ((least == best[rows, ps]) & (start + k < best_code[rows, ps]))
        best[rows[better], ps[better]] = least[better]
        best_code[rows[better], ps[better]] = start + k[better]
    bound, stamp = bound.copy(), stamp.copy()  # groups that stay closed keep the bound and round in which they were measured
    for g, start, rows, ps, d in measured:  # the nearest entry of the group other than the row's own
        d = d.astype(np.float64)
        at = best_code[rows, ps] - start
        inside = (at >= 0) & (at < d.shape[1])
        d[np.nonzero(inside)[0], at[inside]] = np.inf
        bound[rows, ps, g], stamp[rows, ps, g] = np.sqrt(d.min(1)), t
    rows, ps = np.nonzero(best_code != code)  # an entry that was left is now one of its group's others
    g = code[rows, ps] // group
    left = np.sqrt(own[rows, ps].astype(np.float64))
    bound[rows, ps, g], stamp[rows, ps, g] = np.minimum(np.where(stamp[rows, ps, g] == t, bound[rows, ps, g], lower[rows, ps, g]), left), t
    return best_code, bound, stamp, best, scans


STATE = "vec_id long, label long, x array<long>, code binary, bound binary, stamp binary, error long, scans long"


def assign(state: DataFrame, history: list[np.ndarray], parts: int, width: int, group: int) -> DataFrame:
    """The state after one assignment to the last codebook of ``history``; ids and labels stay in Arrow, so none is rounded."""
    groups = -(-history[-1].shape[1] // group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            x = matrix(batch.column("x"), width).reshape(n, parts, -1)
            take = lambda name, kind, shape: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(n, *shape)
            code, stamp = take("code", np.uint8, (parts,)).astype(np.int64), take("stamp", np.uint8, (parts, groups)).astype(np.int64)
            bound = take("bound", np.float32, (parts, groups)).astype(np.float64)
            code, bound, stamp, error, scans = assigned(x, code, bound, stamp, history, group)
            packed = lambda values, kind: pa.array([v.tobytes() for v in values.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("x"), packed(code, np.uint8), packed(bound, np.float32), packed(stamp, np.uint8),
                                              pa.array(error.sum(1)), pa.array(scans + np.array(batch.column("scans")))], names=["vec_id", "label", "x", "code", "bound", "stamp", "error", "scans"])

    return state.mapInArrow(run, STATE)


def moved(state: DataFrame, last: np.ndarray, width: int) -> np.ndarray:
    """Entries replaced by the floored mean of their parts; unused entries stay. Sums are made in the tasks, then by part and entry."""
    parts, entries, m = last.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, m), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column("x"), width).reshape(-1, m)
            at = (np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts) + np.arange(parts) * entries).reshape(-1)
            np.add.at(total, at, x)
            count += np.bincount(at, minlength=len(count))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(count))), pa.array(count), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["slot", "n", "total"])

    each = state.select("x", "code").mapInArrow(sums, "slot long, n long, total array<long>")
    found = each.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(m)]).where("n > 0").collect()
    now = last.copy()
    for r in found:
        now[r["slot"] // entries, r["slot"] % entries] = [int(r[f"s{k}"]) // r["n"] for k in range(m)]
    return now


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, group: int = GROUP) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, x, code, error, scans) of each row that takes part, and the final codebooks (part, entry, component).

    Rows with a null vector or a null or non-finite component take no part, nor do rows of another length than the commonest.
    Repeated rows and null ids are rows like others (in the first codebook null ids come last, equal ids by components); with
    fewer rows than ``entries`` the codebooks are as short. An empty table gives no rows; extra columns are ignored.
    Components beyond 2^28 raise. ``scans`` counts the entry distances computed for a row over all rounds.
    """
    python_ready(vectors.sparkSession)
    rows, width = prepared(vectors, parts, scale)
    book = first_codebooks(rows, parts, entries, width)
    if not book.size:
        return rows.select("vec_id", F.col("label").cast("long"), "x", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("scans")).where("false"), book
    groups = -(-book.shape[1] // group)
    unknown = np.full(parts * groups, -1, np.float32).tobytes()
    state = rows.select("vec_id", F.col("label").cast("long").alias("label"), "x", F.lit(bytes(parts)).alias("code"), F.lit(unknown).alias("bound"), F.lit(bytes(parts * groups)).alias("stamp"),
                        F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("scans"))
    history, old = [book], rows
    for k in range(rounds + 1):
        state = stored(assign(state, history, parts, width, group))
        discard(old)
        old = state
        if k < rounds:
            history.append(moved(state, history[-1], width))
    return state.select("vec_id", "label", "x", "code", "error", "scans"), history[-1]


def code_report(vectors: DataFrame) -> DataFrame:
    codes, book = vector_codes(vectors)
    digest = hashlib.sha256(",".join(str(v) for v in book.reshape(-1).tolist()).encode()).hexdigest()
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    named = with_totals(codes.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error", "scans", F.xxhash64("x").alias("spread")), totals, "label", F.xxhash64("vec_id", "spread"))
    return named.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "scans")
