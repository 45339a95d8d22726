"""Two-mode training examples in alternating uniform batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.sampling import seeded


def paired_slots(sequence: DataFrame, search: DataFrame, key: str, seed: int, cap: int | None = None) -> DataFrame:
    """(key, mode, slot, ordinal): as many examples of either mode, in a seeded order each, strictly alternating.

    cap bounds both modes together: each gets max(1, cap // 2) at most. The even ordinals are sequences.
    """
    from sparkloom.operators.catalog import sequential_ids

    one = lambda df, mode: sequential_ids(df.select(key).withColumn("_h", seeded(seed, key)), ["_h", key], "slot").select(key, F.lit(mode).alias("mode"), "slot")
    both = one(sequence, "sequence").unionByName(one(search, "search"))
    sizes = both.groupBy("mode").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.count("*").alias("modes"))
    each = F.when(F.col("modes") < 2, 0).otherwise(F.least("least", F.lit(max(1, cap // 2))) if cap else F.col("least"))
    kept = both.crossJoin(F.broadcast(sizes)).filter(F.col("slot") < each).drop("least", "modes")
    return kept.withColumn("ordinal", 2 * F.col("slot") + (F.col("mode") == "search").cast("bigint"))


def uniform_batches(slots: DataFrame, batch_size: int, seed: int, epoch: int, drop_last: bool = True) -> DataFrame:
    """(.., batch_id, place): batches of one mode each, modes alternating, in an order of its own for each epoch and mode."""
    from pyspark.sql import Window as W

    from sparkloom.operators.catalog import sequential_ids

    out = None
    for k, mode in enumerate(("sequence", "search")):
        one = slots.filter(F.col("mode") == mode).withColumn("_h", seeded(seed + epoch, "mode", "slot"))
        numbered = sequential_ids(one, ["_h", "slot"], "_n").drop("_h")
        part = numbered.withColumn("batch_id", 2 * F.floor(F.col("_n") / batch_size) + k).withColumn("place", F.col("_n") % batch_size).drop("_n")
        out = part if out is None else out.unionByName(part)
    if drop_last:
        out = out.withColumn("_size", F.count("*").over(W.partitionBy("batch_id"))).filter(F.col("_size") == batch_size).drop("_size")
    return out


def mixed_batches(batches: DataFrame) -> DataFrame:
    """(batch_id) of batches with more than one mode; none are expected."""
    return batches.groupBy("batch_id").agg(F.countDistinct("mode").alias("n")).filter("n > 1").select("batch_id")
