"""Stages over tables: each reads the tables it names, and is written before the next reads it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import clean_text
from sparkloom.operators import catalog as C
from sparkloom.sources.writers import write_table


@dataclass(frozen=True)
class Stage:
    """build takes the tables of needs, in their order, and gives the table name."""

    name: str
    needs: tuple[str, ...]
    build: Callable[..., DataFrame]
    sort_by: str | None = None


def run(spark: SparkSession, stages: list[Stage], source: str, target: str) -> dict[str, DataFrame]:
    """Runs all stages in an order that their needs allow; gives their tables, read again from target.

    A need that is no stage is a Parquet table in source. Names that occur twice and stages
    that need each other in a circle raise ValueError before anything is written.
    """
    by_name = {s.name: s for s in stages}
    if len(by_name) < len(stages):
        raise ValueError("two stages of one name")
    order = TopologicalSorter({s.name: s.needs for s in stages}).static_order()  # CycleError is a ValueError
    done: dict[str, DataFrame] = {}
    for name in [n for n in order if n in by_name]:
        stage = by_name[name]
        write_table(stage.build(*(done[n] if n in by_name else spark.read.parquet(f"{source}/{n}.parquet") for n in stage.needs)), f"{target}/{name}.parquet", stage.sort_by)
        done[name] = spark.read.parquet(f"{target}/{name}.parquet")
    return done


def products(items: DataFrame) -> DataFrame:
    """One row for each key that is not empty."""
    slim = items.select("parent_asin", F.coalesce("title", F.lit("")).alias("title")).filter("parent_asin <> ''")
    return C.last_wins(slim, ["parent_asin"], ["title"])


#: From listings and reviews to the numbered catalogue with splits, its cleaned texts, and the reviews of its items.
CATALOGUE = [
    Stage("products", ("items",), products),
    Stage("split_items", ("products", "interactions"), C.temporal_splits),
    Stage("numbered", ("split_items",), lambda df: C.sequential_ids(df, ["parent_asin"]), "item_id"),
    Stage("texts", ("numbered",), lambda df: df.select("item_id", clean_text(F.col("title"), 200).alias("title")), "item_id"),
    Stage("reviews", ("interactions", "numbered"), lambda df, items: C.semi(df, items, ["parent_asin"])),
]
