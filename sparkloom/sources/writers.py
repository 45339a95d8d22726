"""Writers of stage tables, results and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, sort_by: str | None = None) -> None:
    """A snappy Parquet table, range-sorted by a column if one is named."""
    (df.sort(sort_by) if sort_by else df).write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_if_rows(df: DataFrame, path: str) -> bool:
    """Writes only where there is a row; says whether it did."""
    if df.isEmpty():
        return False
    write_table(df, path)
    return True


def write_results(df: DataFrame, path: str) -> None:
    """A small result as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_log(df: DataFrame, path: str) -> None:
    """A log as CSV with a header."""
    df.coalesce(1).write.mode("append").option("header", "true").csv(path)


def keep_best(df: DataFrame, score: float, best: float | None, folder: str, larger: bool = True) -> float:
    """Writes df as latest, and as best where its score is strictly better; gives the best score."""
    write_table(df, f"{folder}/latest")
    if best is None or (score > best if larger else score < best):
        write_table(df, f"{folder}/best")
        return score
    return best
