"""Connected components of a table of links, without bringing links together in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.shared import materialize, release


def connected_components(links: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, label): the smallest node of each node's component, for nodes that have a link.

    links: (a, b), any order, repeated rows and self-links allowed; ids may be numbers or
    strings. Each round replaces links by stars, first to the smallest neighbour of larger
    neighbours, then of the smaller ones, so the number of rounds grows with the logarithm
    of the longest path. Hubs are pre-aggregated: only minima of neighbourhoods and links
    to them are kept. An empty table gives no rows. Rounds go on until nothing changes;
    more than most_rounds, far beyond any logarithm, raise an error.
    """
    edges = materialize(links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        # large star: every larger neighbour of u is linked to the smallest of u and its neighbours
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m", "u")
        last, edges = edges, materialize(
            small.filter("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        release(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
