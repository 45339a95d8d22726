"""Retrieval metrics over long tables (query_id, rank, item_id), ranks from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hit_ranks(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, hit): the first rank of each query's target, null without a hit."""
    hits = ranked.join(targets.withColumnRenamed("target", "item_id"), ["query_id", "item_id"]).groupBy("query_id").agg(F.min("rank").alias("hit"))
    return targets.select("query_id").join(hits, "query_id", "left")


def recall_ndcg(ranked: DataFrame, targets: DataFrame, ks: list[int]) -> DataFrame:
    """(metric, value): recall@k and ndcg@k for every k in one pass; no queries give 0."""
    hit = F.col("hit")
    cols = []
    for k in ks:
        within = F.coalesce(hit <= k, F.lit(False))
        cols.append(F.coalesce(F.avg(within.cast("double")), F.lit(0.0)).alias(f"recall@{k}"))
        cols.append(F.coalesce(F.avg(F.when(within, 1 / F.log2(hit + F.lit(1.0))).otherwise(F.lit(0.0))), F.lit(0.0)).alias(f"ndcg@{k}"))
    wide = hit_ranks(ranked, targets).agg(*cols)
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in wide.columns))
    return wide.select(F.explode(pairs).alias("m")).select("m.metric", "m.value")


def recall_by_group(ranked: DataFrame, targets: DataFrame, group: str, ks: list[int]) -> DataFrame:
    """(group, n_queries, recall@k..): recall of each group of queries; targets carry the group."""
    hits = hit_ranks(ranked, targets.select("query_id", "target")).join(targets.select("query_id", group), "query_id")
    shares = [F.avg(F.coalesce(F.col("hit") <= k, F.lit(False)).cast("double")).alias(f"recall_{k}") for k in ks]
    return hits.groupBy(group).agg(F.count("*").alias("n_queries"), *shares)


def miss_rate(generated: DataFrame, valid: DataFrame, keys: list[str]) -> DataFrame:
    """(n_generated, n_missing, rate): the share of generated keys that are not valid; none give 0."""
    marked = generated.join(valid.select(*keys).distinct().withColumn("_ok", F.lit(1)), keys, "left")
    return marked.agg(F.count("*").alias("n_generated"), F.sum(F.col("_ok").isNull().cast("bigint")).alias("n_missing")).select(
        "n_generated", F.coalesce("n_missing", F.lit(0)).alias("n_missing"), F.coalesce(F.try_divide(F.col("n_missing"), F.col("n_generated")), F.lit(0.0)).alias("rate")
    )


def misses_last(ranked: DataFrame) -> DataFrame:
    """Ranks again with misses (item_id below 0) behind all hits, otherwise in their order."""
    w = W.partitionBy("query_id").orderBy((F.col("item_id") < 0).cast("int"), "rank")
    return ranked.withColumn("rank", F.row_number().over(w))


def random_baseline(catalog: DataFrame, ks: list[int]) -> DataFrame:
    """(metric, value): recall of a random ranking, k / N."""
    n = catalog.agg(F.count("*").alias("n"))
    pairs = F.array(*(F.struct(F.lit(f"random@{k}").alias("metric"), F.try_divide(F.lit(float(k)), F.col("n")).alias("value")) for k in ks))
    return n.select(F.explode(pairs).alias("m")).select("m.metric", "m.value")
