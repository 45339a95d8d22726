"""The k most similar vectors of every vector by multiprobe p-stable hashing.

A hash is the winner among several random projections: directions a are drawn from the
normal distribution (2-stable) with the data's covariance, projections a x are standardised,
and the largest names the hash. A pair of hashes is a cell. Every vector is stored in its
cell in each of several tables.

A query visits cells in the order of their scores, the sum of its own projections on the
cell's two directions: the nearer a vector, the larger the part of its own winning
projections that the query shares. What score suffices at a cosine is measured when a table
is made, on a bounded sample whose neighbours are known. The best similarities found so far
give the cosine, so queries with near neighbours stop early and only lonely ones look far.
Candidates of all tables are merged and ranked by the exact cosine. Winners of pairs are used
because their cells are the narrower the more there are: the share of all vectors that a
lonely query looks at falls with more vectors, while that of boxes hardly does.

With exact=True there is one table of boxes instead, cells floor((a x + b) / w) of single
projections, hashed again by the widest direction where they are crowded. The distance to a
box's border bounds what it holds; a query visits every box that this does not exclude, and
nothing is lost.

Vectors are written once for each table, sorted by cell, in blocks of bounded size; the
task of some blocks of queries reads the blocks that they visit (blocks.py), so no vector is
shuffled to its queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.blocks import BLOCK, CACHE_BYTES, Blocks, Reader, block_of, cell_counts, lay_out, write_blocks
from sparkloom.llm.vectors import Vectors, first_members, matrix, sample, unit, usable
from sparkloom.shared import materialize

#: Tables, directions of a table, and width of a cell in standard deviations of what is hashed.
TABLES, DIRECTIONS, WIDTH = 2, 16, 1.9
#: Vectors of a cell at most where the sample can tell, rows of the sample that tables are fitted to, and its rows in a cell at least.
CELL, FIT_ROWS, LEAST_FIT = 600, 32_768, 8
#: Share of true neighbours that the cells visited in all tables shall hold, and the sample's queries that measure it.
RECALL, MEASURED, PAIR_MEASURED = 0.98, 512, 2048
#: Cosines that are computed at a time, which the processor's cache holds.
TILE = 1 << 18
#: Queries of a task, and numbers held for the cells of a batch of queries, of an exact search.
QUERIES, SCORES = 8192, 1 << 23
#: Rows of a pair's cell, directions of each hash at most, and queries of a task.
PAIR_CELL, MOST_DIRECTIONS, PAIR_QUERIES = 200, 160, 65_536
#: Parts of the sample, by the cosine of their neighbours, that are measured apart.
WIDTHS = 8
#: Share of the cells that the second pass looks at.
SECOND_PASS = 0.01
#: The first cells that are visited at a time; each further round takes so many times more.
FIRST_VISITS, MORE_VISITS = 1, 6
#: The score of a cell, the sum of two standardised projections, that this share of cells exceeds.
SECOND_SCORE = 2**0.5 * NormalDist().inv_cdf(1 - SECOND_PASS)


class Table:
    """One table of boxes: its directions, and a tree of hashes whose leaves are cells, each a box in the projections' space."""

    def __init__(self, x: np.ndarray, total: int, k: int, seed: int, recall: float) -> None:
        """x: unit vectors of the sample; total: vectors that the table will hold; k: neighbours that are sought."""
        rng = np.random.default_rng(seed)
        dim = x.shape[1]
        values, axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(dim, dim))
        root = axes * np.sqrt(np.maximum(values, 1e-12))
        self.a = np.linalg.qr(root @ rng.standard_normal((dim, min(DIRECTIONS, dim))))[0].astype(np.float32)
        self.nodes: list[tuple[int, np.ndarray, list[int]]] = []  # direction, borders, children; a cell is a child -1 - cell
        boxes: list[tuple[np.ndarray, np.ndarray]] = []
        p = x.astype(np.float32) @ self.a
        most = max(CELL * len(x) / max(total, 1), LEAST_FIT)

        def grow(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> int:
            part = p[rows]
            spread = part.std(axis=0) if len(rows) else np.zeros(p.shape[1])
            j = int(spread.argmax())
            if len(rows) <= most or spread[j] < 1e-6:
                boxes.append((lo, hi))
                return -len(boxes)
            w, mid = WIDTH * spread[j], part[:, j].mean()
            h = np.floor((part[:, j] - mid) / w + rng.uniform())
            b = np.unique(h)
            if len(b) > 1:
                borders = np.array([(part[h < v, j].max() + part[h >= v, j].min()) / 2 for v in b[1:]], np.float32)
            else:
                borders = np.array([mid], np.float32)
            side = np.searchsorted(borders, part[:, j], side="right")
            at = len(self.nodes)
            self.nodes.append((j, borders, []))
            edges = [-np.inf, *borders.tolist(), np.inf]
            for s in range(len(edges) - 1):
                low, high = lo.copy(), hi.copy()
                low[j], high[j] = max(lo[j], edges[s]), min(hi[j], edges[s + 1])
                self.nodes[at][2].append(grow(rows[side == s], low, high))
            return at

        free = np.full(p.shape[1], np.inf, np.float32)
        self.root = grow(np.arange(len(x)), -free, free)
        self.lo, self.hi = (np.array(b, np.float32) for b in zip(*boxes))
        self.bounded = np.maximum((np.isfinite(self.lo) | np.isfinite(self.hi)).sum(axis=1), 1).astype(np.float32)
        self.share = self._measure(x, k, recall, rng)

    def __len__(self) -> int:
        return len(self.lo)

    def _measure(self, x: np.ndarray, k: int, recall: float, rng: np.random.Generator) -> float:
        """The share of r squared, for each direction of a cell, within which that share of the sample's neighbours lies."""
        if len(x) < 2:
            return 1.0
        q = rng.choice(len(x), min(MEASURED, len(x)), replace=False)
        x = x.astype(np.float32)
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -9
        k = min(k, len(x) - 1)
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        r2 = 2 - 2 * np.take_along_axis(s, near, 1).min(axis=1)
        cell = self.cells(x[near.ravel()]).reshape(near.shape)
        far = self.borders(x[q]) / self.bounded
        need = np.take_along_axis(far, cell, 1) / np.maximum(r2, 1e-9)[:, None]
        return float(np.quantile(need, recall))

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each unit vector."""
        p = x @ self.a
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            j, borders, children = self.nodes[node]
            side = np.searchsorted(borders, p[rows, j], side="right")
            for s, child in enumerate(children):
                own = rows[side == s]
                if len(own):
                    todo.append((child, own))
        return out

    def borders(self, x: np.ndarray) -> np.ndarray:
        """The squared distance of each unit vector to each cell's box."""
        p = x @ self.a
        out = np.zeros((len(x), len(self)), np.float32)
        used = [(j, np.ascontiguousarray(self.lo[:, j]), np.ascontiguousarray(self.hi[:, j])) for j in range(p.shape[1]) if np.isfinite(self.lo[:, j]).any() or np.isfinite(self.hi[:, j]).any()]
        step = max(1, (1 << 16) // len(self))  # what is worked on stays in the processor's cache
        gap, other = np.empty((2, step, len(self)), np.float32)
        for at in range(0, len(x), step):
            q, o = p[at : at + step], out[at : at + step]
            g, h = gap[: len(q)], other[: len(q)]
            for j, lo, hi in used:
                np.subtract(lo, q[:, j, None], out=g)
                np.subtract(q[:, j, None], hi, out=h)
                np.maximum(g, h, out=g)
                np.maximum(g, 0, out=g)
                np.multiply(g, g, out=g)
                np.add(o, g, out=o)
        return out


class Pair:
    """One table: a pair of hashes, each the largest of several standardised Gaussian projections; a cell is a pair of winners."""

    def __init__(self, x: np.ndarray, total: int, k: int, seed: int, recall: float) -> None:
        """x: unit vectors of the sample; total: vectors that the table will hold; k: neighbours that are sought."""
        rng = np.random.default_rng(seed)
        dim = x.shape[1]
        values, axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(dim, dim))
        root = axes * np.sqrt(np.maximum(values, 1e-12))
        self.m = int(np.clip(np.sqrt(total / PAIR_CELL), 1, MOST_DIRECTIONS))
        a = (root @ rng.standard_normal((dim, 2 * self.m))).astype(np.float32)
        x = x.astype(np.float32)
        p = x @ a
        spread = np.maximum(p.std(axis=0), 1e-9)
        self.a, self.shift = a / spread, p.mean(axis=0) / spread
        del p
        self.win, self.at, self.width = self._measure(x, k, recall, rng)

    def __len__(self) -> int:
        return self.m * self.m

    def project(self, x: np.ndarray) -> np.ndarray:
        """The standardised projections of each unit vector, a row for each direction."""
        return self.a.T @ x.T - self.shift[:, None]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each unit vector."""
        out = np.zeros(len(x), np.int64)
        for lo in range(0, len(x), 4096):
            z = x[lo : lo + 4096] @ self.a - self.shift
            out[lo : lo + 4096] = z[:, : self.m].argmax(axis=1) * self.m + z[:, self.m :].argmax(axis=1)
        return out

    def _measure(self, x: np.ndarray, k: int, recall: float, rng: np.random.Generator) -> tuple[float, np.ndarray, np.ndarray]:
        """The mean of the winners' sum, and how many standard deviations below what is expected of it that share of the sample's neighbours reaches, by their cosine."""
        if len(x) < 2:
            return 0.0, np.zeros(1), np.full(1, np.inf)
        z = self.project(x)
        win = float((z[: self.m].max(axis=0) + z[self.m :].max(axis=0)).mean())
        q = rng.choice(len(x), min(PAIR_MEASURED, len(x)), replace=False)
        k = min(k, len(x) - 1)
        near, least = np.zeros((len(q), k), np.int64), np.zeros(len(q), np.float32)
        for lo in range(0, len(q), 64):  # the driver holds few of the sample's cosines at a time
            part = q[lo : lo + 64]
            s = x[part] @ x.T
            s[np.arange(len(part)), part] = -9
            near[lo : lo + 64] = np.argpartition(s, len(x) - k, axis=1)[:, len(x) - k :]
            least[lo : lo + 64] = np.take_along_axis(s, near[lo : lo + 64], 1).min(axis=1)
        cell = self.cells(x[near.ravel()]).reshape(near.shape)
        score = z[cell // self.m, q[:, None]] + z[self.m + cell % self.m, q[:, None]]
        off = (score - least[:, None] * win) / _spread(least)[:, None]
        parts = np.array_split(np.argsort(least), max(1, min(WIDTHS, len(q) // 64)))
        return win, np.array([least[r].mean() for r in parts]), np.array([-np.quantile(off[r], 1 - recall) for r in parts])

    def wanted(self, least: np.ndarray) -> np.ndarray:
        """The score of a cell from which on it may hold a neighbour as near as least, which each query has already."""
        return np.where(least < -1, -np.inf, least * self.win - np.interp(least, self.at, self.width) * _spread(least)).astype(np.float32)


def _spread(cosine: np.ndarray) -> np.ndarray:
    """Standard deviation of the sum of two projections of a neighbour at that cosine."""
    return np.sqrt(np.maximum(2 * (1 - np.square(np.clip(cosine, -1, 1))), 1e-6))


@dataclass
class Stored:
    """A table with its blocks: the first block of each cell and how many it has (0: the cell is empty)."""

    table: Table | Pair
    blocks: Blocks
    first: np.ndarray
    count: np.ndarray


def store(v: Vectors, table: Table | Pair) -> Stored:
    """Writes all vectors by their cells. Cells follow each other in blocks; a crowded cell has several of its own."""
    dim = v.dim

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(table), np.int64)
        for b in batches:
            n += np.bincount(table.cells(unit(matrix(b.column("vec"), dim)).astype(np.float32)), minlength=len(table))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["cell", "n"])

    n = cell_counts(v.distinct.select("vec").mapInArrow(count, "cell bigint, n bigint"), len(table))  # at most FIT_ROWS / LEAST_FIT cells
    first, blocks, total = lay_out(n, block_rows(v.count))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = table.cells(unit(matrix(b.column("vec"), dim)).astype(np.float32)) if b.num_rows else np.zeros(0, np.int64)
            block = block_of(cell, b.column("rep").to_numpy(), first, blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(cell.astype(np.int32)), b.column("rep"), b.column("vec")], ["block", "cell", "rep", "vec"])

    placed = v.distinct.select("rep", "vec").mapInArrow(place, "block bigint, cell int, rep bigint, vec binary")
    return Stored(table, write_blocks(placed, total, dim), first, blocks)


def block_rows(count: int) -> int:
    """Vectors of a block: some dozens of blocks for little data, blocks of a fixed size for much."""
    return min(BLOCK, max(2048, count // 24))


def _merge(query: np.ndarray, cand: np.ndarray, cosine: np.ndarray, k: int, n: int) -> tuple[np.ndarray, ...]:
    """The best k candidates of each query, each once, ties to the smaller id, and the least cosine that still counts."""
    order = np.lexsort((cand, query))
    query, cand, cosine = query[order], cand[order], cosine[order]
    new = np.r_[True, (np.diff(query) != 0) | (np.diff(cand) != 0)] if len(query) else np.zeros(0, bool)
    query, cand, cosine = query[new], cand[new], cosine[new]
    order = np.lexsort((cand, -cosine, query))
    query, cand, cosine = query[order], cand[order], cosine[order]
    counts = np.bincount(query, minlength=n)
    place = np.arange(len(query)) - np.repeat(np.cumsum(counts) - counts, counts)
    least = np.full(n, -2.0)
    full = place == k - 1
    least[query[full]] = cosine[full]
    ok = place < k
    return query[ok], cand[ok], cosine[ok], least


class Search:
    """The candidates of a batch of queries, and their visits to the tables."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.wide = unit(raw)
        self.near = self.wide.astype(np.float32)
        self.least = np.full(len(ids), -2.0)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.fresh = 0
        self.visits = 0

    def take(self, who: np.ndarray, rep: np.ndarray, raw: np.ndarray, near: np.ndarray) -> None:
        """Compares some queries with some vectors; those that may be among the k best are scored exactly."""
        for lo in range(0, len(rep), 4096):
            part = slice(lo, lo + 4096)
            step = max(64, TILE // len(near[part]))
            for qo in range(0, len(who), step):
                w = who[qo : qo + step]
                s = self.near[w] @ near[part].T
                self.visits += s.size
                least = self.least[w]
                if s.shape[1] > self.k + 1 and (least < -1).any():  # nothing found yet: the block's own best will do
                    edge = np.partition(s, s.shape[1] - self.k - 1, axis=1)[:, s.shape[1] - self.k - 1]
                    least = np.maximum(least, edge)
                hit = np.flatnonzero((s >= (least - 1e-6).astype(np.float32)[:, None]).ravel())
                i, j = w[hit // s.shape[1]], lo + hit % s.shape[1]
                other = self.ids[i] != rep[j]
                i, j = i[other], j[other]
                if len(i):
                    cosine = np.round(np.einsum("ij,ij->i", self.wide[i], unit(raw[j])), 9)
                    self.held.append((i, rep[j], cosine))
                    self.fresh += len(i)
                if self.fresh > 1 << 19:
                    self.merge()

    def merge(self) -> None:
        if self.fresh:
            *best, self.least = _merge(*(np.concatenate(x) for x in zip(*self.held)), self.k, len(self.ids))
            self.held, self.fresh = [tuple(best)], 0

    def visit_pairs(self, stored: list[Stored], readers: list[Reader]) -> None:
        """Visits the cells of pairs of winners in three passes over all tables: the own cell, the likeliest, and all that may hold something better."""
        before = [np.full(len(self.ids), np.inf, np.float32) for _ in stored]
        for p in range(3):
            for k, (t, reader) in enumerate(zip(stored, readers)):
                pair = t.table
                z = pair.project(self.near)
                z1, z2 = z[: pair.m], z[pair.m :]
                best2 = z2.max(axis=0)
                own = z1.max(axis=0) + best2
                floor = (own, np.minimum(own, np.float32(SECOND_SCORE)), np.full(len(own), -np.inf, np.float32))[p]
                for i in range(pair.m):
                    if not stored[k].count[i * pair.m : (i + 1) * pair.m].any():
                        continue
                    wanted = np.maximum(floor, pair.wanted(self.least))
                    who = np.flatnonzero((z1[i] + best2 >= wanted) & (wanted < before[k]))
                    if not len(who):
                        continue
                    score = z2[:, who] + z1[i, who]
                    j, at = np.nonzero((score >= wanted[who]) & (score < before[k][who]))
                    if len(j):
                        self._round(t, reader, who[at], i * pair.m + j, grouped=True)
                before[k] = floor
            self.merge()

    def visit(self, stored: Stored, reader: Reader) -> None:
        """Visits the table's cells round by round, the nearest first, as long as they may hold something better."""
        table = stored.table
        far = table.borders(self.near)
        far[:, stored.count == 0] = np.inf
        done, width = 0, FIRST_VISITS
        active = np.arange(len(self.ids))
        while len(active) and done < len(table):
            until = min(len(table), done + width)
            last = until == len(table)
            part = far[active]
            order = np.argsort(part, axis=1)[:, :until] if last else np.argpartition(part, until - 1, axis=1)[:, :until]
            reach = (2 - 2 * self.least[active]).astype(np.float32) + np.float32(1e-5)
            d = np.take_along_axis(part, order, 1)
            r, c = np.nonzero((d <= reach[:, None]) & np.isfinite(d))
            cell = order[r, c]
            far[active[r], cell] = np.inf  # visited
            self._round(stored, reader, active[r], cell)
            self.merge()
            # a query goes on if a cell is left within its reach
            active = active[far[active].min(axis=1) <= (2 - 2 * self.least[active]) + 1e-5] if not last else active[:0]
            done, width = 0, width * MORE_VISITS  # visited cells are out of the order, so it begins anew

    def _round(self, stored: Stored, reader: Reader, who: np.ndarray, cell: np.ndarray, grouped: bool = False) -> None:
        if not grouped:
            order = np.argsort(cell, kind="stable")
            who, cell = who[order], cell[order]
        cells, at = np.unique(cell, return_index=True)
        for c, lo, hi in zip(cells.tolist(), at.tolist(), [*at[1:].tolist(), len(cell)]):
            for b in range(int(stored.first[c]), int(stored.first[c] + stored.count[c])):
                if b in reader.blocks.files:
                    block = reader.get(b)
                    start, stop = np.searchsorted(block.cell, [c, c + 1])
                    if stop > start:
                        self.take(who[lo:hi], block.rep[start:stop], block.raw[start:stop], block.near[start:stop])


def fit_tables(x: np.ndarray, total: int, k: int, seed: int, tables: int = TABLES, recall: float = RECALL) -> list[Table]:
    """Tables that miss a neighbour independently and so miss it together with the wanted chance."""
    return [Table(x, total, k, seed + i, 1 - (1 - recall) ** (1 / tables)) for i in range(tables)]


def nearest(v: Vectors, k: int, seed: int = 7, exact: bool = False, tables: int = TABLES, recall: float = RECALL) -> DataFrame:
    """(rep, c, cosine): up to k most similar other distinct vectors of every distinct vector."""
    spark = v.distinct.sparkSession
    x = sample(v, FIT_ROWS)
    if exact:
        made: list[Table] | list[Pair] = fit_tables(x, v.count, k, seed, 1)
        step, group = min(QUERIES, max(256, SCORES // len(made[0]))), 1
    else:
        made = [Pair(x, v.count, k, seed + i, 1 - (1 - recall) ** (1 / tables)) for i in range(tables)]
        step, group = 2 * BLOCK, max(1, min(PAIR_QUERIES, v.count // 18) // block_rows(v.count))
    stored = [store(v, t) for t in made]
    shared = spark.sparkContext.broadcast(stored)  # directions or boxes of a bounded number of cells, and a name for each block
    files = sorted(stored[0].blocks.files)
    tasks = [(files[b : b + group], lo) for b in range(0, len(files), group) for lo in range(0, 2 * block_rows(v.count), step)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(s.blocks, CACHE_BYTES // len(shared.value)) for s in shared.value]
        for batch in batches:
            for numbers, lo in zip(*(c.to_pylist() for c in batch.columns)):
                own = [readers[0].get(b) for b in numbers]
                part = slice(lo, lo + step if lo + step < 2 * block_rows(v_count) else None)
                rep, raw = (np.concatenate([getattr(o, name)[part] for o in own]) for name in ("rep", "raw"))
                own.clear()
                if not len(rep):
                    continue
                s = Search(rep, raw, k)
                if exact:
                    s.visit(shared.value[0], readers[0])
                else:
                    s.visit_pairs(shared.value, readers)
                who, cand, cosine = s.held[0] if s.held else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
                yield pa.RecordBatch.from_arrays([pa.array(s.ids[who]), pa.array(cand), pa.array(cosine)], ["rep", "c", "cosine"])

    v_count = v.count
    work = spark.createDataFrame(spark.sparkContext.parallelize(tasks, max(1, min(len(tasks), 4096))), "blocks array<bigint>, lo int")
    found = materialize(work.mapInArrow(search, "rep bigint, c bigint, cosine double"))
    for s in stored:
        s.blocks.release(spark)
    return found


def neighbours(rows: DataFrame, k: int = 5, id_col: str = "item_id", vec_col: str = "embedding", seed: int = 7, exact: bool = False) -> DataFrame:
    """(item_id, neighbour_id, cosine, place): the k most similar other items of every item.

    Null, empty, zero and non-finite vectors are left out and are no neighbours; a repeated
    row counts once; items that share a vector are neighbours with cosine 1. Cosines are in
    double, rounded to 9 decimals; ties go to the smaller id. Fewer than k + 1 usable items
    give fewer neighbours; an empty table none. The index holds every vector; what is
    approximate is the set of cells that a query visits (recall is measured in the tests),
    and with exact=True nothing is.
    """
    return neighbours_of(usable(rows, id_col, vec_col), k, seed, exact)


def neighbours_of(v: Vectors, k: int, seed: int = 7, exact: bool = False) -> DataFrame:
    """The neighbours of all items of prepared vectors; see neighbours()."""
    spark = v.distinct.sparkSession
    if not v.count:
        return spark.createDataFrame([], "item_id bigint, neighbour_id bigint, cosine double, place int")
    near = nearest(v, k, seed, exact)
    firsts = materialize(first_members(v, k + 1))
    # neighbours by representative: each shared vector stands for its first items, and the own vector for its other items
    wide = near.join(firsts.select(F.col("rep").alias("c"), F.col("item_id").alias("other"), "place"), "c", "left").select("rep", F.coalesce("other", "c").alias("other"), "cosine")
    own = firsts.select("rep", F.col("item_id").alias("other"), F.lit(1.0).alias("cosine"))
    by_rep = W.partitionBy("rep").orderBy(F.desc("cosine"), "other")
    ranked = wide.unionByName(own).withColumn("p", F.row_number().over(by_rep)).filter(F.col("p") <= k + 1).drop("p")
    by_item = W.partitionBy("item_id").orderBy(F.desc("cosine"), "other")
    return (
        v.members.join(ranked, "rep")
        .filter(F.col("item_id") != F.col("other"))
        .withColumn("place", F.row_number().over(by_item))
        .filter(F.col("place") <= k)
        .select("item_id", F.col("other").alias("neighbour_id"), "cosine", "place")
    )
