"""Exact inner-product search in blocks, user vectors and contrastive metrics."""

from __future__ import annotations

from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.vectors import dot, doubles, normalise, rows_of
from sparkloom.shared import materialize

QUERY_BLOCK, ITEM_BLOCK = 4096, 16_384


def mips_topk(queries: DataFrame, catalog: DataFrame, k: int, query_id: str = "query_id", item_id: str = "item_id", query_vec: str = "q", item_vec: str = "embedding") -> DataFrame:
    """(query_id, item_id, score, rank): the k items of the largest inner product, in double, ties to the smaller id.

    A stated set of queries against all items: every pair of a query block and an item block
    is one product of matrices, of which only the block's k best rows leave the task. k is
    clipped to the catalogue.
    """
    q = queries.select(F.col(query_id).cast("bigint").alias("id"), doubles(F.col(query_vec)).alias("v")).filter("v IS NOT NULL")
    c = catalog.select(F.col(item_id).cast("bigint").alias("id"), doubles(F.col(item_vec)).alias("v")).filter("v IS NOT NULL")
    q, c = materialize(q), materialize(c)  # counted, and read once for each block of the other side
    parts_q, parts_i = max(1, -(-q.count() // QUERY_BLOCK)), max(1, -(-c.count() // ITEM_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("bq", F.pmod(F.xxhash64("id"), F.lit(parts_q)).cast("int")).withColumn("bi", every(parts_i)).withColumn("asks", F.lit(True))
    c = c.withColumn("bi", F.pmod(F.xxhash64("id"), F.lit(parts_i)).cast("int")).withColumn("bq", every(parts_q)).withColumn("asks", F.lit(False))

    def block(t: pa.Table) -> pa.Table:
        asks, every_id, x = t.column("asks").to_numpy(), t.column("id").to_numpy(), rows_of(t.column("v"))
        if asks.all() or not asks.any():
            return pa.table({"query_id": pa.array([], pa.int64()), "item_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        b = b[np.argsort(every_id[b])]
        y, ids = x[b], every_id[b]
        keep = min(k, len(ids))
        out: list[tuple[np.ndarray, ...]] = []
        for lo in range(0, len(a), 512):
            part = a[lo : lo + 512]
            s = x[part] @ y.T
            edge = np.partition(s, len(ids) - keep, axis=1)[:, len(ids) - keep]
            r, j = np.nonzero(s >= edge[:, None])
            order = np.lexsort((ids[j], -s[r, j], r))
            r, j = r[order], j[order]
            counts = np.bincount(r, minlength=len(s))
            ok = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts) < keep
            out.append((every_id[part[r[ok]]], ids[j[ok]], s[r[ok], j[ok]]))
        return pa.table(dict(zip(("query_id", "item_id", "score"), (pa.array(np.concatenate(col)) for col in zip(*out)))))

    best = q.unionByName(c).groupBy("bq", "bi").applyInArrow(block, "query_id bigint, item_id bigint, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mean_vectors(rows: DataFrame, key: str, vec: str = "embedding", order: str | None = None) -> DataFrame:
    """(key, q): the normalised mean of each key's vectors, element by element, combined before the shuffle."""
    parts = rows.select(key, F.posexplode(doubles(F.col(vec))).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    packed = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    return packed.select(key, normalise(F.col("v")).alias("q"))


def pair_scores(pairs: DataFrame, scale: float = 1.0) -> DataFrame:
    """(batch_id, i, j, s): inner products of every image with every text of its batch; a batch has a fixed size."""
    left = pairs.select("batch_id", F.col("pair_id").alias("i"), doubles(F.col("image")).alias("a"))
    right = pairs.select("batch_id", F.col("pair_id").alias("j"), doubles(F.col("text")).alias("b"))
    return left.join(right, "batch_id").select("batch_id", "i", "j", (dot(F.col("a"), F.col("b")) * scale).alias("s"))


def in_batch_recall(pairs: DataFrame, k: int = 10) -> DataFrame:
    """(n_pairs, recall): the share of images whose own text is among the k best of their batch."""
    w = W.partitionBy("batch_id", "i").orderBy(F.desc("s"), "j")
    ranked = pair_scores(pairs).withColumn("r", F.row_number().over(w))
    return ranked.filter("i = j").agg(F.count("*").alias("n_pairs"), F.avg((F.col("r") <= k).cast("double")).alias("recall"))


def infonce(pairs: DataFrame, logit_scale: float = 1.0) -> DataFrame:
    """(loss): the mean over all pairs of both directions' cross entropies within their batch."""
    s = pair_scores(pairs, exp(logit_scale))
    own = s.filter("i = j").select("batch_id", F.col("i").alias("id"), F.col("s").alias("own"))

    def side(c: str) -> DataFrame:
        top = s.groupBy("batch_id", c).agg(F.max("s").alias("top"))
        total = s.join(top, ["batch_id", c]).groupBy("batch_id", c).agg((F.log(F.sum(F.exp(F.col("s") - F.col("top")))) + F.max("top")).alias("lse"))
        return total.select("batch_id", F.col(c).alias("id"), F.col("lse").alias(f"lse_{c}"))

    both = own.join(side("i"), ["batch_id", "id"]).join(side("j"), ["batch_id", "id"])
    return both.agg((F.avg((F.col("lse_i") + F.col("lse_j")) / 2 - F.col("own"))).alias("loss"))
