"""Vector search, user vectors, contrastive metrics, retrieval metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import vectors as V
from sparkloom.operators import boxes as D
from sparkloom.operators import history as H
from sparkloom.operators import metrics as M
from sparkloom.operators import mips as I
from sparkloom.plans.common import EVENTS, SID, codebooks, events, sids, vectors
from sparkloom.plans.registry import table

KS = [10, 50, 100]


def _history(spark, folder):
    """Events of users with at least three, with their place from the end."""
    return H.positions(H.with_min_history(events(spark, folder), 2))


def _user_vectors(spark, folder):
    past = _history(spark, folder).filter("from_end > 1").join(vectors(spark, folder), "item_id")
    return I.mean_vectors(past, "user_id")


def _targets(spark, folder):
    last = _history(spark, folder).filter("from_end = 1").join(vectors(spark, folder).select("item_id"), "item_id", "left_semi")
    return last.select(F.col("user_id").alias("query_id"), F.col("item_id").alias("target"))


def _ranked(spark, folder):
    q = _user_vectors(spark, folder).withColumnRenamed("user_id", "query_id").join(_targets(spark, folder).select("query_id"), "query_id", "left_semi")
    return I.mips_topk(q, vectors(spark, folder), 100)


def _rounded(v):
    """Components to six decimals, without a negative zero."""
    return F.transform(v, lambda x: F.round(x, 6) + F.lit(0.0))


def history_vectors(spark, folder):
    """Each user's vector, rounded."""
    return _user_vectors(spark, folder).select("user_id", _rounded(F.col("q")).alias("q"))


def mips_topk(spark, folder):
    """The ten best items of each user's vector."""
    return _ranked(spark, folder).filter("rank <= 10").select("query_id", F.col("rank").cast("bigint").alias("rank"), "item_id")


def mips_metrics(spark, folder):
    """M1, M2, M5."""
    return M.recall_ndcg(_ranked(spark, folder), _targets(spark, folder), KS).select("metric", F.round("value", 6).alias("value"))


def random_baseline(spark, folder):
    """M6."""
    return M.random_baseline(vectors(spark, folder), KS)


def fused_vectors(spark, folder):
    """Each vector fused with the next one, rounded."""
    v = vectors(spark, folder)
    nxt = v.select((F.col("item_id") - 1).alias("item_id"), F.col("embedding").alias("other"))
    f = v.join(nxt, "item_id").select("item_id", V.fuse(F.col("embedding"), F.col("other")).alias("f"))
    return f.select("item_id", _rounded(F.col("f")).alias("f"))


def soft_prompts(spark, folder):
    """A fixed projection to two components, plus the offset of each of four positions."""
    weights = [[(i + k) % 3 - 1.0 for i in range(64)] for k in range(2)]
    prompts = V.soft_prompt(weights, [0.5, -0.5], [[float(p), -float(p)] for p in range(4)], F.col("embedding"))
    rows = vectors(spark, folder).select("item_id", F.posexplode(prompts).alias("position", "p"))
    return rows.select("item_id", F.col("position").cast("bigint").alias("position"), F.round(F.col("p")[0], 6).alias("x"), F.round(F.col("p")[1], 6).alias("y"))


def _pairs(spark, folder):
    """Every vector with the next one, in batches of 128."""
    v = vectors(spark, folder)
    nxt = v.select((F.col("item_id") - 1).alias("pair_id"), F.col("embedding").alias("text"))
    both = v.select(F.col("item_id").alias("pair_id"), F.col("embedding").alias("image")).join(nxt, "pair_id")
    return both.withColumn("batch_id", F.floor(F.col("pair_id") / 128))


def in_batch_recall(spark, folder):
    """V4: over all batches."""
    return I.in_batch_recall(_pairs(spark, folder))


def infonce_loss(spark, folder):
    """V5: over the same batches."""
    return I.infonce(_pairs(spark, folder), 1.0).select(F.round("loss", 6).alias("loss"))


def misses_to_back(spark, folder):
    """Every third rank is a miss."""
    r = _ranked(spark, folder).filter("rank <= 9").withColumn("item_id", F.when(F.col("rank") % 3 == 1, F.lit(-1)).otherwise(F.col("item_id")))
    return M.misses_last(r.select("query_id", "rank", "item_id")).select("query_id", F.col("rank").cast("bigint").alias("rank"), "item_id")


def _boxes(spark, folder):
    e = table(spark, folder, "events")
    at = lambda m, s: (F.col("event_id") % m - s).cast("double")
    return e.select(
        (F.col("event_id") % 97).alias("image_id"), (F.pmod(F.col("event_id") * 7919, F.lit(1009)) / 1009).alias("score"),
        at(53, 10).alias("x0"), at(47, 10).alias("y0"), (at(53, 10) + F.col("event_id") % 31).alias("x1"), (at(47, 10) + F.col("event_id") % 29).alias("y1"),
        F.lit(64).alias("width"), F.lit(48).alias("height"),
    )


def best_boxes(spark, folder):
    """W11."""
    return D.best_box(_boxes(spark, folder))


def clamped_boxes(spark, folder):
    """P19."""
    keyed = _boxes(spark, folder).withColumn("n", F.lit(1))
    return D.clamp(keyed).groupBy("image_id", "cropped", "crop_x0", "crop_y0", "crop_x1", "crop_y1").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        history_vectors, mips_topk, mips_metrics, random_baseline, fused_vectors, soft_prompts, in_batch_recall, infonce_loss, misses_to_back, best_boxes, clamped_boxes,
    )
}
_USERS = f"""
WITH e AS ({EVENTS}), v AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp_ms DESC, ordinal DESC) AS from_end FROM e
      QUALIFY count(*) OVER (PARTITION BY user_id) >= 3),
m AS (SELECT user_id, i, avg(x[i]) AS a FROM h JOIN v USING (item_id), range(1, 65) r(i) WHERE from_end > 1 GROUP BY 1, 2),
u AS (SELECT user_id, list(a ORDER BY i) AS a FROM m GROUP BY 1),
q AS (SELECT user_id, [y / (sqrt(list_inner_product(a, a)) + 1e-9) FOR y IN a] AS q FROM u),
t AS (SELECT user_id AS query_id, item_id AS target FROM h WHERE from_end = 1 AND item_id IN (SELECT item_id FROM v)),
k AS (SELECT user_id AS query_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY list_inner_product(q, x) DESC, item_id) AS rank
      FROM q, v WHERE user_id IN (SELECT query_id FROM t) QUALIFY rank <= 100)"""
_PAIR = """
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
p AS (SELECT a.id, a.id // 128 AS batch, a.x AS image, b.x AS txt FROM v a JOIN v b ON b.id = a.id + 1),
s AS (SELECT a.id AS i, b.id AS j, list_inner_product(a.image, b.txt) AS s FROM p a JOIN p b USING (batch))"""
_BOX = """
WITH b AS (SELECT event_id % 97 AS image_id, ((event_id * 7919) % 1009) / 1009 AS score, CAST(event_id % 53 - 10 AS DOUBLE) AS x0, CAST(event_id % 47 - 10 AS DOUBLE) AS y0,
           CAST(event_id % 53 - 10 + event_id % 31 AS DOUBLE) AS x1, CAST(event_id % 47 - 10 + event_id % 29 AS DOUBLE) AS y1 FROM events)"""
SQL = {
    "history_vectors": _USERS + " SELECT user_id, [round(y, 6) + 0.0 FOR y IN q] AS q FROM q",
    "mips_topk": _USERS + " SELECT query_id, rank, item_id FROM k WHERE rank <= 10",
    "mips_metrics": _USERS + ", r AS (SELECT t.query_id, min(rank) AS hit FROM t LEFT JOIN k ON k.query_id = t.query_id AND k.item_id = t.target GROUP BY 1) " + " UNION ALL ".join(
        f"SELECT 'recall@{n}' AS metric, round(avg(CASE WHEN hit <= {n} THEN 1.0::DOUBLE ELSE 0 END), 6) AS value FROM r UNION ALL "
        f"SELECT 'ndcg@{n}' AS metric, round(avg(CASE WHEN hit <= {n} THEN 1 / log2(hit + 1) ELSE 0 END), 6) AS value FROM r" for n in KS
    ),
    "random_baseline": " UNION ALL ".join(f"SELECT 'random@{n}' AS metric, {n} / count(*)::DOUBLE AS value FROM embeddings" for n in KS),
    "fused_vectors": """
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
m AS (SELECT a.id, [(p[1] + p[2]) / 2 FOR p IN list_zip(a.x, b.x)] AS m FROM v a JOIN v b ON b.id = a.id + 1),
f AS (SELECT id, [y / (sqrt(list_inner_product(m, m)) + 1e-9) FOR y IN m] AS f FROM m)
SELECT id AS item_id, [round(y, 6) + 0.0 FOR y IN f] AS f FROM f""",
    "soft_prompts": """
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
w AS (SELECT id, list_inner_product(x, [CAST(i % 3 - 1 AS DOUBLE) FOR i IN range(64)]) + 0.5 AS a, list_inner_product(x, [CAST((i + 1) % 3 - 1 AS DOUBLE) FOR i IN range(64)]) - 0.5 AS b FROM v)
SELECT id AS item_id, p AS position, round(a + p, 6) AS x, round(b - p, 6) AS y FROM w, range(4) r(p)""",
    "in_batch_recall": _PAIR + """, r AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS r FROM s)
SELECT count(*) AS n_pairs, avg(CASE WHEN r <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS recall FROM r WHERE i = j""",
    "infonce_loss": _PAIR + """, z AS (SELECT i, j, s * exp(1.0::DOUBLE) AS s FROM s), a AS (SELECT i AS id, ln(sum(exp(s))) AS l FROM z GROUP BY 1), b AS (SELECT j AS id, ln(sum(exp(s))) AS l FROM z GROUP BY 1)
SELECT round(avg((a.l + b.l) / 2 - z.s), 6) AS loss FROM z JOIN a ON a.id = z.i JOIN b ON b.id = z.j WHERE z.i = z.j""",
    "misses_to_back": _USERS + """, x AS (SELECT query_id, rank AS r, CASE WHEN rank % 3 = 1 THEN -1 ELSE item_id END AS item_id FROM k WHERE rank <= 9)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN item_id < 0 THEN 1 ELSE 0 END, r) AS rank, item_id FROM x""",
    "best_boxes": _BOX + " SELECT image_id, score, x0, y0, x1, y1 FROM b QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, x0, y0, x1, y1) = 1",
    "clamped_boxes": _BOX + """,
i AS (SELECT image_id, score, greatest(0, least(64, CAST(x0 AS INT))) AS a, greatest(0, least(48, CAST(y0 AS INT))) AS b2, greatest(0, least(64, CAST(x1 AS INT))) AS c, greatest(0, least(48, CAST(y1 AS INT))) AS d FROM b),
g AS (SELECT *, score >= 0.3 AND c > a AND d > b2 AS cropped FROM i)
SELECT image_id, cropped, CASE WHEN cropped THEN a ELSE 0 END AS crop_x0, CASE WHEN cropped THEN b2 ELSE 0 END AS crop_y0, CASE WHEN cropped THEN c ELSE 64 END AS crop_x1,
       CASE WHEN cropped THEN d ELSE 48 END AS crop_y1, count(*) AS n FROM g GROUP BY 1, 2, 3, 4, 5, 6""",
}
