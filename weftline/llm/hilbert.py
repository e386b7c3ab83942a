"""Hilbert index of integer coordinates, from one transition table for columns and for numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _gray(i: int) -> int:
    return i ^ (i >> 1)


def _ungray(g: int) -> int:
    out = 0
    while g:
        out ^= g
        g >>= 1
    return out


def _ones(i: int) -> int:
    """Number of trailing one bits."""
    return ((i ^ (i + 1)).bit_length()) - 1


def _rotate(x: int, by: int, n: int) -> int:
    by %= n
    return ((x << by) | (x >> (n - by))) & ((1 << n) - 1)


@lru_cache
def transitions(n: int) -> tuple[list[int], list[int]]:
    """For each cell ``state * 2**n + quadrant``: the digit on the curve, and the first cell of the next state.

    A state is the entry corner and the axis along which the curve leaves its cube.
    """
    digit, after = [], []
    for state in range(n << n):
        entry, axis = divmod(state, n)
        for quadrant in range(1 << n):
            w = _ungray(_rotate(quadrant ^ entry, n - (axis + 1) % n, n))
            start = _gray(2 * ((w - 1) // 2)) if w else 0
            turn = 0 if w == 0 else _ones(w - 1 if w % 2 == 0 else w) % n
            digit.append(w)
            after.append(((entry ^ _rotate(start, axis + 1, n)) * n + (axis + turn + 1) % n) << n)
    return digit, after


def hilbert_column(levels: Column, n: int, bits: int) -> Column:
    """Index along the curve, as bigint, of an array column of ``n`` integers from 0 to ``2**bits`` - 1."""
    digit, after = (F.array(*[F.lit(v) for v in values]) for values in transitions(n))

    def step(acc, level):
        cell = acc["cell"]
        for k in range(n):
            cell = cell + F.call_function("shiftleft", F.call_function("shiftright", F.get(levels, k), level).bitwiseAND(F.lit(1)), F.lit(k))
        return F.transform(F.array(cell), lambda c: F.struct(F.get(after, c).alias("cell"), (F.shiftleft(acc["index"], n) + F.get(digit, c)).alias("index")))[0]

    start = F.struct(F.lit(0).alias("cell"), F.lit(0).cast("long").alias("index"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(bits - 1, -1, -1)]), start, step, lambda acc: acc["index"])


def hilbert_numpy(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """The same index for an integer array of shape (rows, dimensions)."""
    n = coordinates.shape[1]
    digit, after = (np.array(v, np.int64) for v in transitions(n))
    cell, index = np.zeros(len(coordinates), np.int64), np.zeros(len(coordinates), np.int64)
    for level in range(bits - 1, -1, -1):
        c = cell + (((coordinates.astype(np.int64) >> level) & 1) << np.arange(n)).sum(1)
        index, cell = (index << n) | digit[c], after[c]
    return index
