"""Vectors in numbered blocks of bounded size, one file each in the shared folder, read where they are needed.

A search that compares each block with several others would ship every vector several
times if it grouped rows by pairs of blocks. Instead the vectors are written once, sorted by
block, and the task of a block, or of a pair of blocks, opens the files it needs. A lost
executor loses nothing but its cache.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.vectors import matrix, unit
from sparkloom.shared import shared_dir

#: Vectors of a block.
BLOCK = 16_384
#: Bytes of vectors that a worker keeps at hand.
CACHE_BYTES = 192 << 20


@dataclass
class Blocks:
    """The file of each block; blocks without vectors have none."""

    files: dict[int, str]
    folder: str
    dim: int

    def release(self, spark: SparkSession) -> None:
        """Deletes the files."""
        at = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def lay_out(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First block and number of blocks of each cell, and of all: cells follow each other in blocks of at most so many rows; a larger cell has several of its own."""
    first, blocks = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    at, room = -1, 0
    for c, m in enumerate(sizes.tolist()):
        if not m:
            continue
        if m > most:
            first[c], blocks[c] = at + 1, -(-m // most)
            at, room = at + int(blocks[c]), 0
            continue
        if m > room:
            at, room = at + 1, most
        first[c], blocks[c] = at, 1
        room -= m
    return first, blocks, at + 1


def block_of(cell: np.ndarray, rep: np.ndarray, first: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The block of each row of a cell: by a hash of the row's number, where the cell has several."""
    with np.errstate(over="ignore"):
        mixed = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    return first[cell] + (mixed % np.maximum(blocks[cell], 1).astype(np.uint64)).astype(np.int64)


def cell_counts(parts: DataFrame, n_cells: int) -> np.ndarray:
    """Adds up rows (cell, n), of which each split has one for each cell at most."""
    out = np.zeros(n_cells, np.int64)
    for r in parts.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row for each cell
        out[r.cell] = r.n
    return out


def write_blocks(rows: DataFrame, n_blocks: int, dim: int) -> Blocks:
    """Writes rows (block, cell, rep, vec), sorted by cell within each block; the caller bounds the rows of a block."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    parts = max(1, min(n_blocks, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed = rows.repartition(parts, "block").sortWithinPartitions("block", "cell", "rep")
    placed.write.option("compression", "none").partitionBy("block").parquet(folder)
    # a block lies in one partition and so in one file; a speculative copy of a task commits none
    files = {int(f.split("/block=")[1].split("/")[0]): f for f in spark.read.parquet(folder).inputFiles()} if n_blocks else {}
    return Blocks(files, folder, dim)


def near_unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in single precision."""
    n = np.einsum("ij,ij->i", x, x)
    return x / np.sqrt(n)[:, None] if len(x) and n.min() > 1e-20 and n.max() < 1e20 else unit(x).astype(np.float32) if len(x) else x


@dataclass
class Block:
    """cell, rep, raw vectors and unit vectors of a block's rows."""

    cell: np.ndarray
    rep: np.ndarray
    raw: np.ndarray
    near: np.ndarray

    @property
    def nbytes(self) -> int:
        return self.raw.nbytes + self.near.nbytes + self.cell.nbytes + self.rep.nbytes


class Reader:
    """A worker's way to the blocks, which keeps the ones used last."""

    def __init__(self, blocks: Blocks, most: int = CACHE_BYTES) -> None:
        self.blocks, self.most = blocks, most
        self.held: OrderedDict[int, Block] = OrderedDict()
        self.bytes = 0

    def get(self, number: int) -> Block:
        got = self.held.get(number)
        if got is not None:
            self.held.move_to_end(number)
            return got
        where, path = fs.FileSystem.from_uri(self.blocks.files[number])
        with where.open_input_file(path) as f:
            t = pq.read_table(f, columns=["cell", "rep", "vec"], use_threads=False)
        raw = np.ascontiguousarray(matrix(t.column("vec"), self.blocks.dim))
        got = Block(t.column("cell").to_numpy(), t.column("rep").to_numpy(), raw, near_unit(raw))
        self.held[number] = got
        self.bytes += got.nbytes
        while self.bytes > self.most and len(self.held) > 2:
            self.bytes -= self.held.popitem(last=False)[1].nbytes
        return got
