"""The queries of the core and their SQL, collected from the modules of this package."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("key_totals", "text_plans", "catalog_plans", "history_plans", "sid_plans", "vector_plans", "beam_plans", "schedule_plans", "source_plans")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def collect(attribute: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"sparkloom.plans.{m}"), attribute)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return collect("SQL")
