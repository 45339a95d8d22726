"""Item ids, lookups without fan-out, temporal splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def sequential_ids(df: DataFrame, order: list[str], name: str = "item_id") -> DataFrame:
    """Adds 0, 1, 2, ... in the given order.

    Rows are range-partitioned and numbered within their partition; partitions are moved on
    by the counts before them, so no single task sees all rows. Ties in the order keep
    any order among themselves.
    """
    from sparkloom.shared import materialize

    placed = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    numbered = materialize(placed.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    ahead = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(ahead.select("_part", "_ahead")), "_part")
        .withColumn(name, (F.col("_ahead") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint"))
        .drop("_part", "_ahead", "_at")
    )


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last in the given order: an aggregate, so that a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *(F.col("_r")[c].alias(c) for c in rest)).select(*df.columns)


def last_interaction(interactions: DataFrame, key: str = "parent_asin", ts: str = "timestamp_ms") -> DataFrame:
    """(key, last_ts): the newest timestamp of each key."""
    return interactions.groupBy(key).agg(F.max(ts).alias("last_ts"))


def temporal_splits(items: DataFrame, interactions: DataFrame, key: str = "parent_asin", ts: str = "timestamp_ms", test_days: int = 7, val_days: int = 7) -> DataFrame:
    """Adds split: test, val or train by the newest interaction of the item's key.

    The windows end at the newest interaction of any item; a time exactly at a cut-off
    belongs to the older split. Items without a time above 0 are train, and so are all items
    where there is none.
    """
    last = items.join(last_interaction(interactions, key, ts), key, "left")
    newest = last.agg(F.max(F.when(F.col("last_ts") > 0, F.col("last_ts"))).alias("newest"))  # one row
    age = F.col("newest") - F.col("last_ts")
    valid = F.col("last_ts") > 0
    label = (
        F.when(valid & (age < test_days * DAY_MS), "test").when(valid & (age < (test_days + val_days) * DAY_MS), "val").otherwise("train")
    )
    return last.crossJoin(F.broadcast(newest)).withColumn("split", label).drop("newest", "last_ts")


def split_counts(catalog: DataFrame) -> DataFrame:
    """(split, n_items, n_images, image_share) of each split."""
    return catalog.groupBy("split").agg(
        F.count("*").alias("n_items"), F.sum(F.col("has_image").cast("bigint")).alias("n_images"), F.avg(F.col("has_image").cast("double")).alias("image_share")
    )


def first_per_group(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group; ranks are cut before the shuffle."""
    w = W.partitionBy(group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def semi(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key occurs in keys."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key does not occur in keys; null keys stay."""
    return df.join(keys.select(*on), on, "left_anti")
