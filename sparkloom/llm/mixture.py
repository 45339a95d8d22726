"""Clusters of similar vectors by a Gaussian mixture with exact links.

Unit vectors are reduced to their main components and standardised. Mixtures of several
numbers of components are started on a bounded sample; all rows then decide between them
by the Bayesian information criterion and give the chosen one its parameters in further
rounds of expectation and maximisation, as sums that each split reduces first. A component
of many vectors is divided by a mixture of its own, fitted to a bounded sample of its
vectors, so that the number of components follows the number of vectors. A vector belongs
to every component whose responsibility is not negligible against its best, so that similar
vectors meet in at least one; there, links are checked exactly and reduced to spanning
stars, whose components are the clusters. Vectors are written once for each of their
components (blocks.py), and tasks read the blocks that they compare. The members of the
highest density under the mixture represent a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.blocks import Reader, block_of, cell_counts, lay_out, write_blocks
from sparkloom.llm.components import connected_components
from sparkloom.llm.vectors import Vectors, matrix, moments, sample, unit, usable
from sparkloom.shared import materialize

#: Reduced dimensions; rows of the sample that starts the mixtures; rounds on it and on all rows.
DIMS, FIT_ROWS, START_ROUNDS, ALL_ROUNDS = 20, 12_000, 12, 2
#: Rows for each component in the largest mixture, and the most components.
ROWS_PER_COMPONENT, MOST_COMPONENTS = 1500, 128
#: Shrinkage of covariances to a multiple of the identity, and the least variance.
SHRINK, FLOOR = 0.1, 1e-2
#: A vector joins components whose log responsibility is within this of its best.
GAP = 5.0
#: Vectors of a component from which on it is divided by a mixture of its own.
CROWDED = 12_000
#: Vectors of a component that are compared in one task at most; larger components are compared block by block.
BLOCK = 4096


@dataclass
class Mixture:
    """log weights, means and the inverse Cholesky factors of the covariances."""

    log_w: np.ndarray
    mean: np.ndarray
    white: np.ndarray

    def log_joint(self, z: np.ndarray) -> np.ndarray:
        """log(weight * density) of each row under each component."""
        out = np.empty((len(z), len(self.log_w)))
        for k, (m, w) in enumerate(zip(self.mean, self.white)):
            y = (z - m) @ w
            out[:, k] = self.log_w[k] + np.log(np.abs(np.diag(w))).sum() - 0.5 * (y * y).sum(axis=1)
        return out - 0.5 * z.shape[1] * np.log(2 * np.pi)

    @property
    def n_parameters(self) -> int:
        k, d = self.mean.shape
        return k * (1 + d + d * (d + 1) // 2) - 1


def log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]


def from_sums(n: np.ndarray, s: np.ndarray, ss: np.ndarray) -> Mixture:
    """Maximisation with regularised covariances; empty components keep a broad shape and no weight."""
    k, d = s.shape
    safe = np.maximum(n, 1e-9)[:, None]
    mean = s / safe
    cov = ss / safe[:, :, None] - mean[:, :, None] * mean[:, None, :]
    level = np.trace(cov, axis1=1, axis2=2) / d
    few = n < d + 1
    cov[few], level[few] = np.eye(d), 1.0
    cov = (1 - SHRINK) * cov + (SHRINK * np.maximum(level, FLOOR) + FLOOR)[:, None, None] * np.eye(d)
    white = np.linalg.inv(np.linalg.cholesky(cov)).transpose(0, 2, 1)
    with np.errstate(divide="ignore"):
        return Mixture(np.log(np.maximum(n / max(n.sum(), 1e-9), 1e-12)), mean, white)


def sums_of(z: np.ndarray, mixture: Mixture) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood and the sufficient sums of one expectation step."""
    joint = mixture.log_joint(z)
    total = log_sum(joint)
    r = np.exp(joint - total[:, None])
    ss = np.stack([(z * r[:, [k]]).T @ z for k in range(r.shape[1])])
    return float(total.sum()), r.sum(axis=0), r.T @ z, ss


def start(z: np.ndarray, k: int, rounds: int, seed: int) -> Mixture:
    """A mixture fitted to a sample from distance-weighted centres."""
    rng = np.random.default_rng(seed)
    centres = [z[rng.integers(len(z))]]
    far = ((z - centres[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        p = far / far.sum() if far.sum() > 0 else np.full(len(z), 1 / len(z))
        centres.append(z[rng.choice(len(z), p=p)])
        far = np.minimum(far, ((z - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    near = (-2 * z @ c.T + (c * c).sum(axis=1)).argmin(axis=1)
    one = np.eye(k)[near]
    mixture = from_sums(one.sum(axis=0), one.T @ z, np.stack([(z * one[:, [j]]).T @ z for j in range(k)]))
    for _ in range(rounds):
        mixture = from_sums(*sums_of(z, mixture)[1:])
    return mixture


def _sum_rows(parts: DataFrame) -> np.ndarray:
    """Adds up arrays of equal length, element by element."""
    flat = parts.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(flat))
    for r in flat:
        out[r.i] = r.x
    return out


def fit(v: Vectors, reduce, seed: int) -> Mixture:
    """The mixture of the number of components with the least information criterion over all rows."""
    dim = v.dim
    z = reduce(sample(v, FIT_ROWS))
    top = int(min(MOST_COMPONENTS, max(1, v.count // ROWS_PER_COMPONENT), max(1, len(z) // (2 * z.shape[1]))))
    ladder = sorted({max(1, top // 4), max(1, top // 2), top})
    started = [start(z, k, START_ROUNDS, seed) for k in ladder]

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(started))
        for b in batches:
            z = reduce(unit(matrix(b.column("vec"), dim)))
            total += [log_sum(m.log_joint(z)).sum() for m in started]
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["x"])

    logs = _sum_rows(v.distinct.select("vec").mapInArrow(likelihoods, "x array<double>"))
    best = started[int(np.argmin([m.n_parameters * np.log(v.count) - 2 * x for m, x in zip(started, logs)]))]
    for _ in range(ALL_ROUNDS):
        current = best

        def expect(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            k, d = current.mean.shape
            acc = np.zeros(k * (1 + d + d * d))
            for b in batches:
                z = reduce(unit(matrix(b.column("vec"), dim)))
                _, n, s, ss = sums_of(z, current)
                acc += np.concatenate([n, s.ravel(), ss.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([acc.tolist()], pa.list_(pa.float64()))], ["x"])

        k, d = current.mean.shape
        x = _sum_rows(v.distinct.select("vec").mapInArrow(expect, "x array<double>"))
        best = from_sums(x[:k], x[k : k + k * d].reshape(k, d), x[k + k * d :].reshape(k, d, d))
    return best


def stars(ids: np.ndarray, raw: np.ndarray, least_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(smallest id, other id) for every component of the exact links among these vectors."""
    x = unit(raw)
    f = x.astype(np.float32)
    n = len(ids)
    linked = np.zeros(n, bool)
    for lo in range(0, n, 512):
        s = f[lo : lo + 512] @ f.T >= least_cosine - 1e-5
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = False
        linked[lo : lo + 512] = s.any(axis=1)
    left = np.flatnonzero(linked)
    roots, others = [], []
    while len(left):  # breadth first; every vector is compared once with what is left
        members, edge = [left[:1]], left[:1]
        left = left[1:]
        while len(edge) and len(left):
            met = np.zeros(len(left), bool)
            for lo in range(0, len(edge), 512):
                e = edge[lo : lo + 512]
                s = f[e] @ f[left].T
                met |= (s >= least_cosine + 1e-5).any(axis=0)
                i, j = np.nonzero((np.abs(s - least_cosine) < 1e-5) & ~met[None, :])
                met[j[np.einsum("ij,ij->i", x[e[i]], x[left[j]]) >= least_cosine]] = True
            edge = left[met]
            left = left[~met]
            members.append(edge)
        m = ids[np.concatenate(members)]
        if len(m) > 1:
            roots.append(np.full(len(m) - 1, m.min()))
            others.append(m[m != m.min()])
    none = np.zeros(0, np.int64)
    return (np.concatenate(roots), np.concatenate(others)) if roots else (none, none)


def across(x: np.ndarray, y: np.ndarray, least_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two blocks of unit vectors that have a link, or nearly, with a row of the other."""
    a, b = np.zeros(len(x), bool), np.zeros(len(y), bool)
    for lo in range(0, len(x), 512):
        s = x[lo : lo + 512] @ y.T >= least_cosine - 1e-5
        a[lo : lo + 512] = s.any(axis=1)
        b |= s.any(axis=0)
    return np.flatnonzero(a), np.flatnonzero(b)


@dataclass
class Tree:
    """A mixture, and the mixtures of its crowded components. Cells number the components that are not divided, and those that divide others."""

    top: Mixture
    parts: dict[int, Mixture]

    def __post_init__(self) -> None:
        widths = [len(self.parts[k].log_w) if k in self.parts else 1 for k in range(len(self.top.log_w))]
        self.first = np.cumsum([0, *widths])

    def __len__(self) -> int:
        return int(self.first[-1])

    def cells(self, z: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): every row with each component within the gap of its best, at both levels."""
        joint = self.top.log_joint(z)
        row, part = np.nonzero(joint >= joint.max(axis=1, keepdims=True) - gap)
        rows, cells = [], []
        plain = ~np.isin(part, list(self.parts))
        rows.append(row[plain])
        cells.append(self.first[part[plain]])
        for k, mixture in self.parts.items():
            own = row[part == k]
            if len(own):
                inner = mixture.log_joint(z[own])
                r, c = np.nonzero(inner >= inner.max(axis=1, keepdims=True) - gap)
                rows.append(own[r])
                cells.append(self.first[k] + c)
        return np.concatenate(rows), np.concatenate(cells)


def divide(v: Vectors, reduce, top: Mixture, gap: float, seed: int) -> Tree:
    """Gives each crowded component a mixture of its own: one group for each, of at most about FIT_ROWS of its vectors."""
    dim = v.dim
    tree = Tree(top, {})
    sizes = count_cells(v, reduce, tree, gap)
    crowded = np.flatnonzero(sizes > CROWDED)
    if not len(crowded):
        return tree
    share = np.minimum(1.0, FIT_ROWS / np.maximum(sizes, 1))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, part = tree.cells(reduce(unit(matrix(b.column("vec"), dim))), gap)
            rep = b.column("rep").to_numpy()[row]
            with np.errstate(over="ignore"):
                drawn = ((rep.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(11)) / 2.0**53  # the same on every run
            ok = np.isin(part, crowded) & (drawn < share[part])
            yield pa.RecordBatch.from_arrays([pa.array(part[ok]), b.column("vec").take(pa.array(row[ok]))], ["part", "vec"])

    def inner(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        z = reduce(unit(matrix(t.column("vec"), dim)))
        z = z[np.lexsort(z.T)]  # whatever the order of rows
        k = int(min(MOST_COMPONENTS, sizes[part] // ROWS_PER_COMPONENT, len(z) // (2 * z.shape[1])))
        m = start(z, max(1, k), START_ROUNDS, seed)
        return pa.table({"part": pa.array([part], pa.int64()), "x": pa.array([np.concatenate([m.log_w, m.mean.ravel(), m.white.ravel()]).tolist()], pa.list_(pa.float64()))})

    parts = {}
    d = top.mean.shape[1]
    for r in v.distinct.select("rep", "vec").mapInArrow(members, "part bigint, vec binary").groupBy("part").applyInArrow(inner, "part bigint, x array<double>").collect():  # MOST_COMPONENTS rows at most
        x = np.array(r.x)
        k = len(x) // (1 + d + d * d)
        parts[r.part] = Mixture(x[:k], x[k : k + k * d].reshape(k, d), x[k + k * d :].reshape(k, d, d))
    return Tree(top, parts)


def count_cells(v: Vectors, reduce, tree: Tree, gap: float) -> np.ndarray:
    dim = v.dim

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(tree), np.int64)
        for b in batches:
            n += np.bincount(tree.cells(reduce(unit(matrix(b.column("vec"), dim))), gap)[1], minlength=len(tree))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["cell", "n"])

    return cell_counts(v.distinct.select("vec").mapInArrow(count, "cell bigint, n bigint"), len(tree))


@dataclass
class Clusters:
    """labels: (item_id, first_item_id, n) of all members; scored: (item_id, density); components of the mixture."""

    labels: DataFrame
    scored: DataFrame
    n_components: int = 0


def similarity_clusters(
    rows: DataFrame, least_cosine: float = 0.85, least_size: int = 4, id_col: str = "item_id", vec_col: str = "embedding", seed: int = 11, exact: bool = False
) -> Clusters:
    """Clusters of items joined by links of at least that cosine, directly or through others.

    Null, empty, zero and non-finite vectors belong to no cluster; a repeated row counts
    once; items that share a vector are linked. Clusters of fewer than least_size items are
    left out. first_item_id is the smallest item of the cluster. An empty table gives no rows.
    exact: compares all vectors, whatever their components, so that no link can be missed; the
    work is then quadratic.
    """
    v = usable(rows, id_col, vec_col)
    spark = rows.sparkSession
    if not v.count:
        none = spark.createDataFrame([], "item_id bigint, first_item_id bigint, n bigint")
        return Clusters(none, spark.createDataFrame([], "item_id bigint, density double"))
    dim = v.dim
    mean, cov = moments(v.distinct, dim)
    values, axes = np.linalg.eigh(cov)
    d = min(DIMS, dim)
    turn = axes[:, -d:] / np.sqrt(np.maximum(values[-d:], 1e-6))

    def reduce(x: np.ndarray) -> np.ndarray:
        """Main components of unit vectors."""
        return (x - mean) @ turn if len(x) else np.zeros((0, d))

    mixture = fit(v, reduce, seed)
    one = Mixture(np.zeros(1), np.zeros((1, d)), np.eye(d)[None])
    tree = Tree(one, {}) if exact else divide(v, reduce, mixture, GAP, seed)
    sizes = count_cells(v, reduce, tree, GAP)
    first, blocks, total = lay_out(sizes, BLOCK)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, cell = tree.cells(reduce(unit(matrix(b.column("vec"), dim))), GAP)
            rep = b.column("rep").to_numpy()[row]
            block = block_of(cell, rep, first, blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(cell.astype(np.int32)), pa.array(rep), b.column("vec").take(pa.array(row))], ["block", "cell", "rep", "vec"])

    stored = write_blocks(v.distinct.select("rep", "vec").mapInArrow(place, "block bigint, cell int, rep bigint, vec binary"), total, dim)
    # a task for each block, in which its cells are compared, and for each pair of blocks of one cell
    alone = spark.range(total).select(F.col("id").alias("i"), F.col("id").alias("j"))
    divided = spark.createDataFrame([(int(first[c]), int(first[c] + blocks[c] - 1)) for c in np.flatnonzero(blocks > 1)], "lo bigint, hi bigint")
    pairs = divided.select("hi", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("i")).select("i", F.explode(F.sequence(F.col("i") + 1, "hi")).alias("j"))
    shared = spark.sparkContext.broadcast(stored)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            for i, j in zip(*(x.to_pylist() for x in batch.columns)):
                if i not in reader.blocks.files or j not in reader.blocks.files:
                    continue
                x, y = reader.get(i), reader.get(j)
                if i != j:
                    p, q = across(x.near, y.near, least_cosine)
                    a, b = stars(np.concatenate([x.rep[p], y.rep[q]]), np.concatenate([x.raw[p], y.raw[q]]), least_cosine)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    continue
                at = np.flatnonzero(np.r_[True, np.diff(x.cell) != 0, True])
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                    a, b = stars(x.rep[lo:hi], x.raw[lo:hi], least_cosine)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    work = alone.unionByName(pairs).repartition(max(1, min(total, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))), "i", "j")
    links = materialize(work.mapInArrow(link, "a bigint, b bigint").distinct())
    stored.release(spark)
    labels = connected_components(links)
    items = materialize(v.members.join(labels, v.members.rep == labels.node, "left").select("item_id", F.coalesce("label", "rep").alias("label")))
    kept = items.groupBy("label").agg(F.count("*").alias("n"), F.min("item_id").alias("first_item_id")).filter(F.col("n") >= least_size)

    def density(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = reduce(unit(matrix(b.column("vec"), dim)))
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(log_sum(mixture.log_joint(z)))], ["rep", "density"])

    scored = v.distinct.select("rep", "vec").mapInArrow(density, "rep bigint, density double")
    by_item = v.members.join(scored, "rep").select("item_id", "density")
    return Clusters(items.join(kept, "label").select("item_id", "first_item_id", "n"), by_item, len(mixture.log_w) if exact else len(tree))


def describe(clusters: Clusters, typical: int = 3) -> DataFrame:
    """(first_item_id, n_items, typical_item_ids): size and the members of highest density, densest first."""
    w = W.partitionBy("first_item_id").orderBy(F.desc("density"), "item_id")
    return (
        clusters.labels.join(clusters.scored, "item_id")
        .withColumn("place", F.row_number().over(w))
        .filter(F.col("place") <= typical)
        .groupBy("first_item_id")
        .agg(F.max("n").alias("n_items"), F.transform(F.array_sort(F.collect_list(F.struct("place", "item_id"))), lambda x: x["item_id"]).alias("typical_item_ids"))
    )
