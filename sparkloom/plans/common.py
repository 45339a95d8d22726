"""Inputs that several plans share, in Spark and in SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import quantize
from sparkloom.plans.registry import table

LEVELS, CODES = 4, 64

EVENTS = "SELECT user_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS item_id, epoch_ms(ts) AS timestamp_ms, event_id AS ordinal FROM events"
SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The event log as interactions of users with vectors."""
    return table(spark, folder, "events").select(
        "user_id", F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("item_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), F.col("event_id").alias("ordinal")
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")


@functools.lru_cache(maxsize=4)
def codebooks(spark: SparkSession, folder: str) -> list:
    return quantize.seeded_codebooks(vectors(spark, folder), LEVELS, CODES, "item_id", "embedding")


def sids(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, sid_0..sid_3) under codebooks of one round of k-means over all vectors."""
    return quantize.assign(vectors(spark, folder), codebooks(spark, folder)).drop("error")


def sid_ctes() -> str:
    """CTEs item2feat(item_id, sid_0..sid_3, error) and book_l(code, c) under the same codebooks."""
    out = ["r0 AS MATERIALIZED (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS r FROM embeddings)"]
    nearest = lambda rows, book, carried: (
        f"SELECT item_id, r{carried}, code, c FROM (SELECT x.*, b.code, b.c, row_number() OVER (PARTITION BY x.item_id ORDER BY list_distance(x.r, b.c), b.code) AS rn FROM {rows} x, {book} b) WHERE rn = 1"
    )
    for k in range(LEVELS):
        carried = "".join(f", sid_{i}" for i in range(k))
        out.append(f"seed_{k} AS MATERIALIZED (SELECT item_id - {k * CODES} AS code, r AS c FROM r{k} WHERE item_id BETWEEN {k * CODES} AND {(k + 1) * CODES - 1})")
        out.append(f"m{k} AS (SELECT code, i, avg(x) AS x FROM (SELECT code, unnest(r) AS x, generate_subscripts(r, 1) AS i FROM ({nearest(f'r{k}', f'seed_{k}', '')})) GROUP BY code, i)")
        out.append(f"book_{k} AS MATERIALIZED (SELECT s.code, coalesce(m.c, s.c) AS c FROM seed_{k} s LEFT JOIN (SELECT code, list(x ORDER BY i) AS c FROM m{k} GROUP BY code) m USING (code))")
        out.append(f"a{k} AS MATERIALIZED (SELECT item_id, r{carried}, code AS sid_{k}, c FROM ({nearest(f'r{k}', f'book_{k}', carried)}))")
        out.append(f"r{k + 1} AS MATERIALIZED (SELECT item_id{carried}, sid_{k}, [p[1] - p[2] FOR p IN list_zip(r, c)] AS r FROM a{k})")
    out.append(f"item2feat AS MATERIALIZED (SELECT item_id, {', '.join(f'sid_{i}' for i in range(LEVELS))}, list_inner_product(r, r) AS error FROM r{LEVELS})")
    return ",\n".join(out)


SID = "WITH " + sid_ctes()
S4 = ", ".join(f"sid_{i}" for i in range(LEVELS))
