"""Vectors as integers: rows that take part, floored components, and packing of Arrow columns into numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Greatest size of an integer component for which sums of squares over 64 components fit a 64-bit integer.
LIMIT = 1 << 28


def sound(name: str) -> Column:
    """Whether a vector and all of its components are there and finite."""
    v = F.col(f"`{name}`")
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))


def usual_length(df: DataFrame, name: str) -> int | None:
    """The commonest number of components (the smallest of equals); None for no rows."""
    found = df.groupBy(F.size(f"`{name}`").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found and found["n"]


def floored(name: str, scale: int) -> Column:
    """Components floor(scale * x), x as double."""
    return F.transform(F.col(f"`{name}`"), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column of ``width`` integers in each row as a matrix of int64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)
    if values.size and max(-int(values.min()), int(values.max())) >= LIMIT:
        raise ValueError(f"components of {LIMIT} and more are not supported")
    return values
