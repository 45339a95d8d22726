"""Vector expressions in double; arrays of any numeric type."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column, epsilon: float = 1e-9) -> Column:
    """v / (|v| + epsilon)."""
    length = norm(v) + F.lit(epsilon)
    return F.transform(doubles(v), lambda x: x / length)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def squared_distance(a: Column, b: Column) -> Column:
    d = subtract(a, b)
    return F.aggregate(F.transform(d, lambda x: x * x), F.lit(0.0), lambda s, x: s + x)


def fuse(image: Column, text: Column) -> Column:
    """The normalised mean of two vectors."""
    return normalise(F.zip_with(doubles(image), doubles(text), lambda x, y: (x + y) / 2))


def affine(weights: list[list[float]], bias: list[float], q: Column) -> Column:
    """W q + b."""
    rows = [dot(F.array(*(F.lit(float(x)) for x in row)), q) + F.lit(float(b)) for row, b in zip(weights, bias)]
    return F.array(*rows)


def soft_prompt(weights: list[list[float]], bias: list[float], offsets: list[list[float]], q: Column) -> Column:
    """The projected query plus the offset of each position: an array of vectors."""
    p = affine(weights, bias, q)
    return F.array(*(F.zip_with(p, F.array(*(F.lit(float(x)) for x in o)), lambda x, y: x + y) for o in offsets))


def rows_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
