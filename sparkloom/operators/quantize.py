"""Residual quantisation: each level codes what the levels before have left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.vectors import rows_of
from sparkloom.shared import materialize, release


def nearest(rest: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest code of each row, ties to the lower one, a bounded number of rows at a time."""
    half = (book * book).sum(axis=1)
    step = max(1, (1 << 21) // len(book))
    return np.concatenate([(half - 2 * rest[lo : lo + step] @ book.T).argmin(axis=1) for lo in range(0, len(rest), step)]) if len(rest) else np.zeros(0, np.int64)


def _slim(embeddings: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    return embeddings.select(F.col(id_col).cast("bigint").alias(id_col), F.col(vec_col).cast("array<double>").alias("v")).filter(F.size("v") == dim)


def assign(embeddings: DataFrame, codebooks: list[np.ndarray], id_col: str = "item_id", vec_col: str = "embedding") -> DataFrame:
    """(id, sid_0.., error): the nearest code of each level to the residual, ties to the lower code; error is the squared rest.

    codebooks: one (codes, dim) array for each level, at most some thousands of codes. Null
    vectors and vectors of another length are left out.
    """
    names = [f"sid_{k}" for k in range(len(codebooks))]
    books = [np.asarray(b, np.float64) for b in codebooks]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rest = rows_of(b.column("v"))
            out = [b.column(id_col)]
            for book in books:
                code = nearest(rest, book)
                out.append(pa.array(code.astype(np.int64)))
                rest = rest - book[code]
            yield pa.RecordBatch.from_arrays([*out, pa.array((rest * rest).sum(axis=1))], [id_col, *names, "error"])

    return _slim(embeddings, id_col, vec_col, books[0].shape[1]).mapInArrow(work, f"{id_col} bigint, " + ", ".join(f"{n} bigint" for n in names) + ", error double")


def code_sums(vectors: DataFrame, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int, float, np.ndarray]:
    """Over rows with vectors v: counts (level, code) and residual sums (level, code, dim) of all codes, rows, squared rests, and those before each level.

    Each split adds up its own rows first; levels * codes * (dim + 1) numbers come to the driver, whatever the data.
    """
    shape = (len(books), *books[0].shape)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, left = np.zeros(shape[:2]), np.zeros(shape), np.zeros(shape[0] + 2)
        for b in batches:
            rest = rows_of(b.column("v"))
            for k, book in enumerate(books):
                code = nearest(rest, book)
                counts[k] += np.bincount(code, minlength=shape[1])
                order = np.argsort(code, kind="stable")
                head = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0]) if len(code) else []
                if len(head):
                    sums[k, code[order][head]] += np.add.reduceat(rest[order], head, axis=0)
                left[2 + k] += (rest * rest).sum()
                rest = rest - book[code]
            left[:2] += len(rest), (rest * rest).sum()
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([counts.ravel(), sums.ravel(), left]).tolist()], pa.list_(pa.float64()))], ["x"])

    parts = vectors.mapInArrow(work, "x array<double>").select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    x = np.zeros(np.prod(shape[:2]) + np.prod(shape) + shape[0] + 2)
    x[parts.column("i").to_numpy()] = parts.column("x").to_numpy()
    n = int(np.prod(shape[:2]))
    left = x[n + int(np.prod(shape)) :]
    return x[:n].reshape(shape[:2]), x[n : n + int(np.prod(shape))].reshape(shape), int(left[0]), float(left[1]), left[2:]


def fit(embeddings: DataFrame, levels: int = 4, codes: int = 1024, vec_col: str = "embedding", seed: int = 42, rounds: int = 10) -> list[np.ndarray]:
    """Codebooks by k-means on the residuals, level by level; a level has as many codes as distinct residuals at most."""
    rest = materialize(embeddings.filter(F.size(vec_col) > 0).select(F.col(vec_col).cast("array<double>").alias("v")))
    books: list[np.ndarray] = []
    for level in range(levels):
        model = KMeans(k=codes, seed=seed, maxIter=rounds, featuresCol="f", predictionCol="c").fit(rest.select(array_to_vector("v").alias("f")))
        book = np.array(model.clusterCenters())
        books.append(book)
        if level == levels - 1:
            break

        def work(batches: Iterator[pa.RecordBatch], book=book) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = rows_of(b.column("v"))
                if len(x):
                    x = x - book[nearest(x, book)]
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))], ["v"])

        last, rest = rest, materialize(rest.mapInArrow(work, "v array<double>"))
        release(last)
    release(rest)
    return books


def train(
    embeddings: DataFrame, codebooks: list[np.ndarray], epochs: int = 1, batches: int = 1, decay: float = 0.99, commitment: float = 0.25, epsilon: float = 1e-5,
    id_col: str = "item_id", vec_col: str = "embedding",
) -> tuple[list[np.ndarray], list[tuple[int, float, float]]]:
    """Codebooks after training by moving averages, and (epoch, mse, commitment loss) of each epoch.

    All levels code the same batch with the codes of the batches before. Each code's count and
    sum of residuals then move towards the batch's by 1 - decay, and a code is its smoothed sum
    divided by its count; a code that nothing chose keeps its place. An epoch has so many
    batches, by a hash of the id, which are steps of the distributed data; its losses are the
    means over its batches. Vectors themselves are not trained, so the commitment loss is the
    reconstruction's error times its weight.
    """
    books = [np.array(b, np.float64) for b in codebooks]
    dim = books[0].shape[1]
    rows = materialize(_slim(embeddings, id_col, vec_col, dim).select("v", F.pmod(F.xxhash64(id_col), F.lit(batches)).alias("batch")))
    count = np.ones((len(books), len(books[0])))
    total = np.stack(books).copy()
    history = []
    for epoch in range(epochs):
        losses = []
        for b in range(batches):
            n, s, size, rest, _ = code_sums(rows.filter(F.col("batch") == b).select("v"), books)
            if not size:
                continue
            losses.append(rest / (size * dim))
            count = decay * count + (1 - decay) * n
            total = decay * total + (1 - decay) * s
            every = count.sum(axis=1, keepdims=True)
            smooth = (count + epsilon) / (every + count.shape[1] * epsilon) * every
            books = list(total / smooth[:, :, None])
        mse = float(np.mean(losses)) if losses else 0.0
        history.append((epoch + 1, mse, commitment * mse))
    release(rows)
    return books, history


def seeded_codebooks(embeddings: DataFrame, levels: int, codes: int, id_col: str, vec_col: str) -> list[np.ndarray]:
    """Codebooks of one round of k-means over all vectors, level by level.

    The seeds of level l are the residuals of the rows l * codes .. (l + 1) * codes - 1 by id;
    a code is the mean of the residuals that are nearest to its seed.
    """
    first = embeddings.filter(F.col(id_col) < levels * codes).orderBy(id_col).select(F.col(vec_col).cast("array<double>")).collect()  # levels * codes rows
    x = np.array([r[0] for r in first])
    rows = _slim(embeddings, id_col, vec_col, x.shape[1]).select("v")
    books: list[np.ndarray] = []
    for k in range(levels):
        seeds = x[k * codes : (k + 1) * codes].copy()
        n, s, *_ = code_sums(rows, [*books, seeds])
        books.append(np.where(n[k][:, None] > 0, s[k] / np.maximum(n[k], 1)[:, None], seeds))
        x = x - books[k][nearest(x, books[k])]
    return books


def reconstruction(assigned: DataFrame, dim: int, commitment: float = 0.25) -> DataFrame:
    """(mse, commitment_loss) over all rows."""
    mse = F.avg("error") / dim
    return assigned.agg(mse.alias("mse"), (commitment * mse).alias("commitment_loss"))
