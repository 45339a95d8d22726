"""Semantic ids: assignment, lookup, collisions, prefix tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import quantize as Q
from sparkloom.operators import sid as S
from sparkloom.plans.common import CODES, S4, SID, codebooks, sids, vectors
from sparkloom.plans.registry import table


def sid_assign(spark, folder):
    """Q2."""
    return sids(spark, folder)


def sid_reconstruction(spark, folder):
    """Q3, A17."""
    return Q.reconstruction(Q.assign(vectors(spark, folder), codebooks(spark, folder)), 64).select(F.round("mse", 6).alias("mse"), F.round("commitment_loss", 6).alias("commitment_loss"))


def ema_codebooks(spark, folder):
    """The codebooks after one step over all vectors by moving averages, each code's first component and length, and the step's losses."""
    v = vectors(spark, folder)
    books, history = Q.train(v, codebooks(spark, folder), epochs=1, batches=1)
    rows = [(level, code, float(c[0]), float(np.linalg.norm(c))) for level, b in enumerate(books) for code, c in enumerate(b)]
    losses = spark.createDataFrame(history, "epoch int, mse double, commitment_loss double")
    out = spark.createDataFrame(rows, "level int, code int, first double, length double").crossJoin(F.broadcast(losses))
    return out.select("level", "code", "epoch", *(F.round(c, 6).alias(c) for c in ("first", "length", "mse", "commitment_loss")))


def ema_training(spark, folder):
    """Losses of five epochs of four batches each; no SQL."""
    _, history = Q.train(vectors(spark, folder), codebooks(spark, folder), epochs=5, batches=4, decay=0.9)
    return spark.createDataFrame(history, "epoch int, mse double, commitment_loss double")


def kmeans_codebooks(spark, folder):
    """Q1, Q4: codebooks of 1,024 codes a level, or as many as there are residuals, and what they leave; no SQL."""
    v = vectors(spark, folder)
    books = Q.fit(v, levels=4, codes=1024, seed=42)
    got = Q.assign(v, books)
    sizes = spark.createDataFrame([(k, len(b), float(np.linalg.norm(b, axis=1).mean())) for k, b in enumerate(books)], "level int, n_codes int, mean_norm double")
    return sizes.crossJoin(F.broadcast(Q.reconstruction(got, 64)))


def sid_join(spark, folder):
    """Parts with their codes, null where they have none."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("item_id"), "p_name")
    return S.join_sids(parts, sids(spark, folder))


def items_with_sids(spark, folder):
    """F4."""
    return sid_join(spark, folder).dropna(subset=["sid_0", "sid_1", "sid_2", "sid_3"])


def sid_lookup(spark, folder):
    """A4, O6."""
    return S.sid_to_item(sids(spark, folder))


def sid_collisions(spark, folder):
    """A5, F11, O7."""
    return S.collisions(sids(spark, folder)).orderBy(F.desc("n_items"), F.col("item_ids")[0])


def collision_stats(spark, folder):
    """A6, A8."""
    return S.collision_stats(sids(spark, folder))


def codebook_usage(spark, folder):
    """A7."""
    return S.codebook_usage(sids(spark, folder), CODES)


def largest_collisions(spark, folder):
    """The five largest groups."""
    return sid_collisions(spark, folder).select("n_items", F.col("item_ids")[0].alias("first_item")).orderBy(F.desc("n_items"), "first_item").limit(5)


def trie_levels(spark, folder):
    """Prefixes of every length."""
    out = None
    for k, level in enumerate(S.trie_levels(sids(spark, folder))):
        cols = [F.col(f"sid_{i}") if i <= k else F.lit(-1).cast("bigint").alias(f"sid_{i}") for i in range(4)]
        part = level.select(F.lit(k + 1).cast("bigint").alias("length"), *cols)
        out = part if out is None else out.unionByName(part)
    return out


def trie_membership(spark, folder):
    """Codes, and codes with the last one moved on."""
    s = sids(spark, folder)
    moved = s.withColumn("sid_3", (F.col("sid_3") + 1) % CODES)
    return S.is_valid(S.trie_levels(s), s.unionByName(moved)).select("item_id", "sid_0", "sid_1", "sid_2", "sid_3", "valid")


def trie_children(spark, folder):
    """The codes after each prefix of two, and their mask."""
    t = S.trie_levels(sids(spark, folder))
    nxt = S.children(t, t[1]).groupBy("sid_0", "sid_1").agg(F.array_sort(F.collect_set("sid_2")).alias("codes"))
    return nxt.select("sid_0", "sid_1", "codes", S.allowed_mask(F.col("codes"), CODES).alias("mask"))


def trie_masked_logits(spark, folder):
    """T5: logits 0, 1, .. with all but the allowed codes blocked."""
    logits = F.transform(F.sequence(F.lit(0), F.lit(CODES - 1)), lambda i: i.cast("double"))
    return trie_children(spark, folder).select("sid_0", "sid_1", S.mask_logits(logits, F.col("codes")).alias("logits"))


QUERIES = {
    f.__name__: f
    for f in (
        sid_assign, sid_reconstruction, ema_codebooks, ema_training, kmeans_codebooks, sid_join, items_with_sids, sid_lookup, sid_collisions, collision_stats, codebook_usage, largest_collisions,
        trie_levels, trie_membership, trie_children, trie_masked_logits,
    )
}
_GROUPS = f", g AS (SELECT {S4}, count(*) AS n_items, list(item_id ORDER BY item_id) AS item_ids FROM item2feat GROUP BY {S4})"
_CHILD = f", ch AS (SELECT sid_0, sid_1, list(sid_2 ORDER BY sid_2) AS codes FROM (SELECT DISTINCT sid_0, sid_1, sid_2 FROM item2feat) GROUP BY 1, 2)"
SQL = {
    "sid_assign": SID + f" SELECT item_id, {S4} FROM item2feat",
    "sid_reconstruction": SID + " SELECT round(avg(error) / 64, 6) AS mse, round(0.25 * avg(error) / 64, 6) AS commitment_loss FROM item2feat",
    "ema_codebooks": SID + ", z AS (" + " UNION ALL ".join(
        f"SELECT {k} AS level, code, list(x ORDER BY i) AS s, any_value(n) AS n FROM (SELECT code, i, sum(x) AS x, count(*) AS n FROM "
        f"(SELECT sid_{k} AS code, unnest(r) AS x, generate_subscripts(r, 1) AS i FROM (SELECT a{k}.sid_{k}, r{k}.r FROM a{k} JOIN r{k} USING (item_id))) GROUP BY 1, 2) GROUP BY code" for k in range(4)
    ) + "), b AS (" + " UNION ALL ".join(f"SELECT {k} AS level, code, c FROM book_{k}" for k in range(4)) + f"""),
m AS (SELECT b.level, b.code, 0.99 + 0.01 * coalesce(n, 0) AS n, CASE WHEN s IS NULL THEN [0.99 * y FOR y IN c] ELSE [0.99 * p[1] + 0.01 * p[2] FOR p IN list_zip(c, s)] END AS t FROM b LEFT JOIN z USING (level, code)),
e AS (SELECT level, code, t, n, sum(n) OVER (PARTITION BY level) AS every FROM m),
w AS (SELECT level, code, [y / ((n + 1e-5) / (every + {CODES} * 1e-5) * every) FOR y IN t] AS v FROM e)
SELECT level, code, 1 AS epoch, round(v[1], 6) AS first, round(sqrt(list_inner_product(v, v)), 6) AS length,
       (SELECT round(avg(error) / 64, 6) FROM item2feat) AS mse, (SELECT round(0.25 * avg(error) / 64, 6) FROM item2feat) AS commitment_loss FROM w""",
    "sid_join": SID + f" SELECT p_partkey AS item_id, p_name, {S4} FROM part LEFT JOIN item2feat ON p_partkey = item_id",
    "items_with_sids": SID + f" SELECT p_partkey AS item_id, p_name, {S4} FROM part JOIN item2feat ON p_partkey = item_id",
    "sid_lookup": SID + f" SELECT {S4}, min(item_id) AS item_id FROM item2feat GROUP BY {S4}",
    "sid_collisions": SID + _GROUPS + " SELECT * FROM g WHERE n_items >= 2",
    "collision_stats": SID + _GROUPS + """
SELECT CAST(sum(n_items) AS BIGINT) AS n_total, count(*) AS n_unique, count(*) FILTER (WHERE n_items >= 2) AS n_groups,
       CAST(sum(n_items) - count(*) AS BIGINT) AS n_lost, (sum(n_items) - count(*)) / sum(n_items) AS share_lost FROM g""",
    "codebook_usage": SID + " " + " UNION ALL ".join(f"SELECT {k} AS level, count(DISTINCT sid_{k}) AS n_used, count(DISTINCT sid_{k}) / {CODES}.0::DOUBLE AS share_used FROM item2feat" for k in range(4)),
    "largest_collisions": SID + _GROUPS + " SELECT n_items, item_ids[1] AS first_item FROM g WHERE n_items >= 2 ORDER BY n_items DESC, first_item LIMIT 5",
    "trie_levels": SID + " " + " UNION ALL ".join(
        f"SELECT DISTINCT CAST({k + 1} AS BIGINT) AS length, " + ", ".join(f"sid_{i}" if i <= k else f"-1 AS sid_{i}" for i in range(4)) + " FROM item2feat" for k in range(4)
    ),
    "trie_membership": SID + f""", x AS (SELECT item_id, {S4} FROM item2feat UNION ALL SELECT item_id, sid_0, sid_1, sid_2, (sid_3 + 1) % {CODES} FROM item2feat)
SELECT item_id, {S4}, ({S4}) IN (SELECT ({S4}) FROM item2feat) AS valid FROM x""",
    "trie_children": SID + _CHILD + f" SELECT sid_0, sid_1, codes, [list_contains(codes, i) FOR i IN range({CODES})] AS mask FROM ch",
    "trie_masked_logits": SID + _CHILD + f" SELECT sid_0, sid_1, [CASE WHEN list_contains(codes, i) THEN CAST(i AS DOUBLE) ELSE -1e9 END FOR i IN range({CODES})] AS logits FROM ch",
}
