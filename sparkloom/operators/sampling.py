"""Seeded samples, shuffles and splits by hashes, the same on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seeded(seed: int, *keys: str) -> Column:
    """A uniform hash of the keys under a seed, as hexadecimal text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def sample_exact(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows (all if there are fewer) in the order of their seeded hash."""
    return df.orderBy(seeded(seed, key), key).limit(n)


def sample_per_stratum(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each stratum by the order of their seeded hash."""
    w = W.partitionBy(stratum).orderBy(seeded(seed, stratum, key), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def shuffled(df: DataFrame, key: str, seed: int, name: str = "ordinal") -> DataFrame:
    """Adds an ordinal from 0 in a random order."""
    from sparkloom.operators.catalog import sequential_ids

    return sequential_ids(df.withColumn("_h", seeded(seed, key)), ["_h", key], name).drop("_h")


def tail_split(df: DataFrame, share: float, ordinal: str = "ordinal", most: int | None = None) -> DataFrame:
    """Adds part: val for the last max(1, floor(n * share)) ordinals (most at most), train for the rest."""
    n = df.agg(F.count("*").alias("_n"))  # one row
    size = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    size = F.least(size, F.lit(most)) if most else size
    return df.crossJoin(F.broadcast(n)).withColumn("part", F.when(F.col(ordinal) >= F.col("_n") - size, "val").otherwise("train")).drop("_n")
