"""Usable vectors: cleaned, one for each item, equal vectors kept once with their items."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.shared import materialize


#: Items besides the first of shared vectors, up to which they are broadcast where the vectors are read.
MOST_EXTRA = 1_000_000


@dataclass
class Vectors:
    """distinct: (rep, vec) with vec as float32 bytes; rep is the smallest item of that vector.

    classes: (rep, n) of vectors that several items share; members: (item_id, rep) of all items.
    """

    distinct: DataFrame
    classes: DataFrame
    members: DataFrame
    dim: int
    count: int


def usable(rows: DataFrame, id_col: str = "item_id", vec_col: str = "embedding") -> Vectors:
    """Drops null ids, null, empty, zero and non-finite vectors and those of another length than most rows have.

    A repeated row counts once; of different vectors of one item the one of the smallest
    bytes stays. Vectors are shuffled and written once; equal ones are found by 96 bits of
    their hashes.
    """
    v = F.col("v")
    slim = rows.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(vec_col).cast("array<float>").alias("v")).filter(
        F.col("item_id").isNotNull() & (F.size(v) > 0)
    )
    fine = slim.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    lengths = fine.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        empty = fine.select("item_id", F.col("item_id").alias("rep"), F.lit(b"").alias("vec"))
        return Vectors(empty.select("rep", "vec"), empty.select("rep", F.lit(1).alias("n")), empty.select("item_id", "rep"), 1, 0)
    dim = lengths.d

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.ascontiguousarray(b.column("v").flatten().to_numpy(), np.float32) + np.float32(0)  # no negative zero
            raw = pa.Array.from_buffers(
                pa.binary(), b.num_rows, [None, pa.py_buffer(np.arange(b.num_rows + 1, dtype=np.int32) * (4 * dim)), pa.py_buffer(x)]
            )
            yield pa.RecordBatch.from_arrays([b.column("item_id"), raw], ["item_id", "vec"])

    one = fine.filter(F.size("v") == dim).mapInArrow(pack, "item_id bigint, vec binary").groupBy("item_id").agg(F.min("vec").alias("vec"))
    packed = materialize(one.withColumn("h", F.xxhash64("vec")).withColumn("c", F.crc32("vec")))
    shared = materialize(packed.groupBy("h", "c").agg(F.min("item_id").alias("rep"), F.count("*").alias("n")).filter("n > 1"))
    copies = materialize(packed.select("item_id", "h", "c").join(shared, ["h", "c"]).select("item_id", "rep"))
    extra = copies.filter("item_id <> rep").select(F.col("item_id").alias("rep"))
    n_extra = extra.count()
    distinct = packed.select(F.col("item_id").alias("rep"), "vec")
    if 0 < n_extra <= MOST_EXTRA:
        distinct = distinct.join(F.broadcast(extra), "rep", "left_anti")
    elif n_extra:
        distinct = materialize(distinct.join(extra, "rep", "left_anti"))
    members = packed.select("item_id").join(copies, "item_id", "left").select("item_id", F.coalesce("rep", "item_id").alias("rep"))
    return Vectors(distinct, shared.select("rep", "n"), members, dim, packed.count() - n_extra)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The float32 rows of a binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    data = column.buffers()[2]
    return np.frombuffer(data, np.float32, len(column) * dim, int(start)).reshape(len(column), dim) if len(column) else np.zeros((0, dim), np.float32)


def sample(v: Vectors, most: int) -> np.ndarray:
    """The unit vectors of about most vectors, all of them if there are no more: those of the smallest hashes.

    Each split sends only the vectors whose hash lies below the wanted share.
    """
    rows = v.distinct
    if v.count > most:
        rows = rows.filter(F.xxhash64("rep", F.lit(1)) < F.lit(int(-(2**63) + most / v.count * 2.0**64)))
    t = rows.toArrow().sort_by("rep")
    return unit(matrix(t.column("vec"), v.dim)) if len(t) else np.zeros((0, v.dim))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def moments(distinct: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the unit vectors, from all rows, summed in each split first."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = unit(matrix(b.column("vec"), dim))
            n, s, ss = n + len(x), s + x.sum(axis=0), ss + x.T @ x
        yield pa.RecordBatch.from_pylist([{"n": n, "s": s.tolist(), "ss": ss.ravel().tolist()}], pa.schema([("n", pa.int64()), ("s", pa.list_(pa.float64())), ("ss", pa.list_(pa.float64()))]))

    parts = distinct.select("vec").mapInArrow(sums, "n bigint, s array<double>, ss array<double>")
    flat = parts.select("n", F.posexplode(F.concat("s", "ss")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()
    total = max(1, flat[0].n if flat else 1)
    x = np.array([r.x for r in flat]) if flat else np.zeros(dim + dim * dim)
    mean = x[:dim] / total
    return mean, x[dim:].reshape(dim, dim) / total - np.outer(mean, mean)


def first_members(v: Vectors, k: int) -> DataFrame:
    """(rep, item_id, place): the k smallest items of each shared vector."""
    w = W.partitionBy("rep").orderBy("item_id")
    return v.members.join(v.classes.select("rep"), "rep").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
