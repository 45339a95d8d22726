"""Schedules and optimiser steps over generated steps."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sparkloom.functions import schedule as L

TOTAL, WARMUP = 1000, 100


def lr_schedules(spark, folder):
    """Warm-up with cosine, and one cycle."""
    step = F.col("step")
    return spark.range(TOTAL).select(F.col("id").alias("step")).select(
        "step", F.round(L.warmup_cosine(step, WARMUP, TOTAL), 6).alias("cosine"), F.round(L.one_cycle(step, TOTAL, 1.0), 6).alias("one_cycle")
    )


def training_steps(spark, folder):
    """P25: optimiser steps for the documents of each language and source, with and without a stated number."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("n_rows"))
    rows = groups.select("*", F.lit(16).alias("batch_size"), F.lit(4).alias("accumulate"), F.lit(8).alias("epochs"), F.when(F.col("n_rows") > 20, 500).otherwise(0).alias("max_steps"))
    return L.step_counts(rows).select("lang", "source", "n_rows", "total_steps")


def anchored_adamw_step(spark, folder):
    """The first step for every line of the order table, its price as the gradient's scale."""
    o = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", (F.col("o_totalprice") / 1e5).alias("x"))
    new = L.anchored_adamw(F.col("x"), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.col("x") - 2, 1, lr=0.1)
    return o.select("o_orderkey", *(F.round(c, 9).alias(n) for n, c in new.items()))


QUERIES = {f.__name__: f for f in (lr_schedules, training_steps, anchored_adamw_step)}
_A, _B = f"{1 - 0.9!r}::DOUBLE", f"{1 - 0.999!r}::DOUBLE"
_UP = 0.3 * TOTAL - 1
SQL = {
    "lr_schedules": f"""
SELECT i AS step, round(CASE WHEN i < {WARMUP} THEN (i + 1) / {WARMUP}::DOUBLE ELSE greatest(0.0, 0.5 * (1 + cos({math.pi!r} * least(1.0, (i - {WARMUP}) / {TOTAL - WARMUP}::DOUBLE)))) END, 6) AS cosine,
       round(CASE WHEN i <= {_UP} THEN 1.0 + (0.125 - 1.0) / 2 * (1 + cos({math.pi!r} * i / {_UP}::DOUBLE))
                  ELSE 0.00125 + (1.0 - 0.00125) / 2 * (1 + cos({math.pi!r} * (i - {_UP}) / {TOTAL - 1 - _UP}::DOUBLE)) END, 6) AS one_cycle
FROM range({TOTAL}) t(i)""",
    "training_steps": """
SELECT lang, source, count(*) AS n_rows,
       CAST(CASE WHEN count(*) > 20 THEN 500 ELSE greatest(1, greatest(1, (count(*) + 15) // 16) // 4) * 8 END AS BIGINT) AS total_steps FROM documents GROUP BY lang, source""",
    "anchored_adamw_step": f"""
WITH a AS (SELECT o_orderkey, o_totalprice / 1e5 AS x, o_totalprice / 1e5 - 2 AS g FROM orders),
b AS (SELECT o_orderkey, x - 0.1::DOUBLE * ({_A} * g / {_A}) / (sqrt({_B} * g * g / {_B}) + 1e-8::DOUBLE) AS t, {_A} * g AS m, {_B} * g * g AS v FROM a)
SELECT o_orderkey, round(t - 0.001::DOUBLE * (t - 1.0), 9) AS theta, round(m, 9) AS m, round(v, 9) AS v FROM b""",
}
