"""Time-ordered user histories. Events carry an ordinal, so equal times keep their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.shared import materialize


def positions(events: DataFrame, user: str = "user_id", order: tuple[str, ...] = ("timestamp_ms", "ordinal")) -> DataFrame:
    """Adds position (from 0), n_events and from_end (1 = last) within each user's history.

    Rows are range-partitioned by user and time, so a user of very many rows spans several
    tasks; what lies ahead of each of these is added from a table that has a row for each
    partition such a user spans. Users with a null key are one user.
    """
    placed = materialize(events.repartitionByRange(user, *order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(user, "_part").agg(F.count("*").alias("_n"))
    several = counts.groupBy(user).agg(F.count("*").alias("_k"), F.sum("_n").alias("_total"), F.array_sort(F.collect_list(F.struct("_part", "_n"))).alias("_parts")).filter("_k > 1")
    # ranges meet in at most one user, so all these lists together have at most two entries for each partition
    earlier = F.expr("aggregate(filter(_parts, p -> p._part < _p._part), 0L, (s, p) -> s + p._n)")
    spans = several.select(F.col(user).alias("_user"), "_total", F.explode("_parts").alias("_p"), "_parts").select("_user", "_total", F.col("_p._part").alias("_span"), earlier.alias("_ahead"))
    own = W.partitionBy(user, "_part")
    local = placed.withColumn("_at", F.row_number().over(own.orderBy(*order)).cast("bigint") - 1).withColumn("_own", F.count("*").over(own))
    joined = local.join(F.broadcast(spans), F.col(user).eqNullSafe(F.col("_user")) & (F.col("_part") == F.col("_span")), "left")
    with_n = joined.withColumn("position", F.col("_at") + F.coalesce("_ahead", F.lit(0))).withColumn("n_events", F.coalesce("_total", "_own"))
    return with_n.select(*events.columns, "position", "n_events", (F.col("n_events") - F.col("position")).alias("from_end"))


def with_min_history(events: DataFrame, min_history: int, user: str = "user_id") -> DataFrame:
    """Events of users with more than min_history events."""
    enough = events.groupBy(user).agg(F.count("*").alias("n")).filter(F.col("n") >= min_history + 1).select(user)
    return events.join(enough, user, "left_semi")


def last_events(events: DataFrame, n: int, user: str = "user_id", order: tuple[str, ...] = ("timestamp_ms", "ordinal")) -> DataFrame:
    """The last n events of each user; ranks are cut before the shuffle, so a hot user ships n rows a task."""
    w = W.partitionBy(user).orderBy(*(F.desc(c) for c in order))
    return events.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def chains(events: DataFrame, value: str, cap: int = 50, user: str = "user_id", order: tuple[str, ...] = ("timestamp_ms", "ordinal"), min_length: int = 1) -> DataFrame:
    """(user, chain): the last cap values of each user in order; users with fewer than min_length are left out."""
    capped = last_events(events, cap, user, order)
    packed = F.array_sort(F.collect_list(F.struct(*order, value)))
    return capped.groupBy(user).agg(F.transform(packed, lambda x: x[value]).alias("chain")).filter(F.size("chain") >= min_length)


def split_last(chained: DataFrame) -> DataFrame:
    """(user.., history, target) from chains of at least two: the last value is the target."""
    n = F.size("chain")
    return chained.filter(n >= 2).withColumn("history", F.slice("chain", F.lit(1), n - 1)).withColumn("target", F.get("chain", n - 1)).drop("chain")
