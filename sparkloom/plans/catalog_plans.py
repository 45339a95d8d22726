"""The catalogue: ids, splits, lookups, limits and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions.text import clean_text as clean
from sparkloom.operators import catalog as C
from sparkloom.plans.registry import table
from sparkloom.plans.text_plans import clean_sql


def item_ids(spark, folder):
    """O1, O2: ids in key order; equal keys are told apart by all other columns that decide."""
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    return C.sequential_ids(parts, ["p_partkey"])


def last_timestamps(spark, folder):
    """A1."""
    return C.last_interaction(table(spark, folder, "interactions"))


def temporal_split(spark, folder):
    """A2, A3, J2, F14, P18."""
    return C.temporal_splits(table(spark, folder, "catalog").drop("split"), table(spark, folder, "interactions")).select("item_id", "parent_asin", "split")


def split_counts(spark, folder):
    """A13."""
    return C.split_counts(table(spark, folder, "catalog"))


def dedupe_last_wins(spark, folder):
    """The last listing of each key."""
    return C.last_wins(table(spark, folder, "catalog").select("parent_asin", "title", "item_id"), ["parent_asin"], ["item_id"])


def whitelist_semi_join(spark, folder):
    """F2 as a semi join on two columns."""
    return C.semi(table(spark, folder, "catalog"), table(spark, folder, "category_whitelist"), ["main_category", "sub_category"]).select("item_id", "main_category", "sub_category")


def reviews_semi_join(spark, folder):
    """Reviews of known items with defaults for missing values."""
    rows = C.semi(table(spark, folder, "interactions"), table(spark, folder, "items"), ["parent_asin"])
    return rows.select(
        F.coalesce("parent_asin", F.lit("")).alias("parent_asin"), F.coalesce("user_id", F.lit("")).alias("user_id"), F.coalesce("rating", F.lit(0.0)).alias("rating"),
        F.coalesce("timestamp_ms", F.lit(0)).alias("timestamp_ms"), "helpful_vote", "verified_purchase",
    )


def per_category_limit(spark, folder):
    """The first 50 items of each main category, of the union of its parts."""
    items = table(spark, folder, "catalog")
    parts = [items.filter(c).select("main_category", "item_id") for c in ("has_image", "NOT coalesce(has_image, false)")]
    return C.first_per_group(parts[0].unionByName(parts[1]), "main_category", ["item_id"], 50)


def todo_anti_join(spark, folder):
    """Items with an image address that have no image yet."""
    rows = table(spark, folder, "catalog").filter("image_url <> ''").select("item_id", "image_url")
    done = table(spark, folder, "embeddings_b2").select("item_id")
    return C.anti(rows, done, ["item_id"])


def image_rows(spark, folder):
    """Training items with an image and a vector, with their cleaned title."""
    rows = table(spark, folder, "catalog").filter("split = 'train' AND has_image")
    kept = C.semi(rows, table(spark, folder, "embeddings_b2").filter("embedding IS NOT NULL"), ["item_id"])
    return kept.select("item_id", clean(F.col("title"), 200).alias("text"))


def interacted_keys(spark, folder):
    """Distinct keys."""
    return table(spark, folder, "interactions").select("parent_asin").distinct()


def exact_distinct_users(spark, folder):
    """Exact, by grouping first, so that no task gathers the users."""
    users = table(spark, folder, "interactions").filter("user_id IS NOT NULL").groupBy("user_id").agg(F.lit(1))
    return users.agg(F.count("*").alias("n_users"))


def ingest_counts(spark, folder):
    """Rows seen and kept."""
    rows = table(spark, folder, "interactions")
    known = table(spark, folder, "items").select("parent_asin").distinct().withColumn("kept", F.lit(1))
    return rows.join(known, "parent_asin", "left").agg(F.count("*").alias("n_seen"), F.coalesce(F.sum("kept"), F.lit(0)).cast("bigint").alias("n_kept"))


QUERIES = {
    f.__name__: f
    for f in (
        item_ids, last_timestamps, temporal_split, split_counts, dedupe_last_wins, whitelist_semi_join, reviews_semi_join, per_category_limit, todo_anti_join, image_rows,
        interacted_keys, exact_distinct_users, ingest_counts,
    )
}
SQL = {
    "item_ids": "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS item_id FROM part",
    "last_timestamps": "SELECT parent_asin, max(timestamp_ms) AS last_ts FROM interactions GROUP BY 1",
    "temporal_split": """
WITH l AS (SELECT parent_asin, max(timestamp_ms) AS t FROM interactions GROUP BY 1),
c AS (SELECT item_id, catalog.parent_asin, t FROM catalog LEFT JOIN l USING (parent_asin)),
m AS (SELECT max(t) FILTER (WHERE t > 0) AS newest FROM c)
SELECT item_id, parent_asin, CASE WHEN t > 0 AND t > newest - 7 * 86400000 THEN 'test' WHEN t > 0 AND t > newest - 14 * 86400000 THEN 'val' ELSE 'train' END AS split FROM c, m""",
    "split_counts": "SELECT split, count(*) AS n_items, CAST(sum(CAST(has_image AS BIGINT)) AS BIGINT) AS n_images, avg(CAST(has_image AS DOUBLE)) AS image_share FROM catalog GROUP BY 1",
    "whitelist_semi_join": "SELECT item_id, main_category, sub_category FROM catalog SEMI JOIN category_whitelist USING (main_category, sub_category)",
    "reviews_semi_join": """
SELECT coalesce(parent_asin, '') AS parent_asin, coalesce(user_id, '') AS user_id, coalesce(rating, 0.0) AS rating, coalesce(timestamp_ms, 0) AS timestamp_ms, helpful_vote, verified_purchase
FROM interactions SEMI JOIN items USING (parent_asin)""",
    "per_category_limit": "SELECT main_category, item_id FROM catalog QUALIFY row_number() OVER (PARTITION BY main_category ORDER BY item_id) <= 50",
    "todo_anti_join": "SELECT item_id, image_url FROM catalog ANTI JOIN embeddings_b2 USING (item_id) WHERE image_url <> ''",
    "image_rows": f"""SELECT item_id, {clean_sql('title', 200)} AS text FROM catalog
WHERE split = 'train' AND has_image AND item_id IN (SELECT item_id FROM embeddings_b2 WHERE embedding IS NOT NULL)""",
    "interacted_keys": "SELECT DISTINCT parent_asin FROM interactions",
    "exact_distinct_users": "SELECT count(DISTINCT user_id) AS n_users FROM interactions",
    "ingest_counts": "SELECT count(*) AS n_seen, count(*) FILTER (WHERE parent_asin IN (SELECT parent_asin FROM items)) AS n_kept FROM interactions",
}
SQL |= {"dedupe_last_wins": "SELECT parent_asin, title, item_id FROM catalog QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY item_id DESC) = 1"}
