"""Sources over files that are written from the test tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkloom.plans.registry import table
from sparkloom.shared import shared_dir
from sparkloom.sources import readers as R

#: Lines that are no JSON, between the records.
BROKEN = ("{broken", "", "not a record", '{"parent_asin": "X"')


def _lines(records, name):
    """A folder of gzipped JSON lines: each record, and each broken line once."""
    spark = records.sparkSession
    where = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    lines = records.select(F.to_json(F.struct("*")).alias("value")).unionByName(spark.createDataFrame([(x,) for x in BROKEN], "value string"))
    lines.write.option("compression", "gzip").text(where)
    return where


def jsonl_items(spark, folder):
    """Listings from JSON lines."""
    i = table(spark, folder, "items")
    raw = i.select(
        "main_category", "parent_asin", "title", F.array("description").alias("description"), F.split("features", r" \| ").alias("features"), F.col("price").cast("string").alias("price"),
        "average_rating", "rating_number", "store", "categories", F.array(F.struct(F.lit(None).cast("string").alias("large"), F.lit("t").alias("thumb")), F.struct(F.col("image_url").alias("large"), F.lit("t").alias("thumb"))).alias("images"),
    )
    return R.project_items(R.read_json_lines(spark, _lines(raw, "items"), "raw_item", 4))


def jsonl_reviews(spark, folder):
    """Reviews of known items from JSON lines."""
    a = table(spark, folder, "interactions").select("parent_asin", "user_id", "rating", F.col("timestamp_ms").alias("timestamp"), "helpful_vote", "verified_purchase")
    return R.read_reviews(spark, _lines(a, "reviews"), table(spark, folder, "items"), 4)


def fetch_outcomes(spark, folder):
    """What comes of fetching each image address from a server that answers by the address's length."""

    def fetch(url: str) -> tuple[int, bytes]:
        n = len(url) % 6
        if n == 0:
            raise TimeoutError
        return (200, 404, 503, 200, 429)[n - 1], b"x" * (50 if n == 4 else 150)

    todo = table(spark, folder, "catalog").select("item_id", F.col("image_url").alias("url"))
    return R.fetch_files(todo, fetch, attempts=2, backoff=0).select("item_id", "ok", "reason", F.length("body").cast("bigint").alias("n_bytes"))


QUERIES = {f.__name__: f for f in (jsonl_items, jsonl_reviews, fetch_outcomes)}
SQL = {
    "jsonl_items": """
SELECT coalesce(main_category, '') AS main_category, coalesce(parent_asin, '') AS parent_asin, trim(coalesce(title, '')) AS title, substr(coalesce(description, ''), 1, 2000) AS description,
       substr(coalesce(features, ''), 1, 2000) AS features, price, coalesce(average_rating, 0.0) AS average_rating, coalesce(rating_number, 0) AS rating_number, coalesce(store, '') AS store,
       coalesce(categories, []) AS categories, coalesce(categories[2], '') AS sub_category, coalesce(image_url, '') AS image_url FROM items""",
    "jsonl_reviews": """
SELECT coalesce(parent_asin, '') AS parent_asin, coalesce(user_id, '') AS user_id, coalesce(rating, 0.0) AS rating, coalesce(timestamp_ms, 0) AS timestamp_ms,
       coalesce(helpful_vote, 0) AS helpful_vote, coalesce(verified_purchase, false) AS verified_purchase
FROM interactions WHERE coalesce(parent_asin, '') IN (SELECT parent_asin FROM items)""",
    "fetch_outcomes": """
SELECT item_id, coalesce(image_url, '') <> '' AND length(image_url) % 6 = 1 AS ok,
       CASE WHEN coalesce(image_url, '') = '' THEN 'no url' ELSE ['TimeoutError', '', 'http 404', 'http 503', 'short body', 'http 429'][length(image_url) % 6 + 1] END AS reason,
       CASE WHEN image_url <> '' AND length(image_url) % 6 = 1 THEN 150 END AS n_bytes FROM catalog""",
}
