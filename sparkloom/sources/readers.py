"""Readers: JSON lines, stage tables, file listings and fetched files."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.functions.text import element_or, first_match


def read_json_lines(spark: SparkSession, path: str | list[str], name: str, partitions: int | None = None) -> DataFrame:
    """Rows of (compressed) JSON lines in a declared schema; lines that are no JSON are skipped.

    A field of another type becomes null, its line stays. A compressed file is one
    partition, so the rows may be spread over more afterwards.
    """
    lines = spark.read.text(path)
    if partitions:
        lines = lines.repartition(partitions)
    typed = schemas.schema(name).add("_bad", "string")
    parsed = lines.select(F.from_json("value", typed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), "value")
    is_json = F.try_parse_json(F.col("value"))
    return parsed.filter(F.col("r").isNotNull() & is_json.isNotNull() & (F.trim("value") != "")).select("r.*").drop("_bad")


def project_items(raw: DataFrame) -> DataFrame:
    """Raw item records as rows of items, without price conversion: defaults, joined and cut texts, first large image."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    joined = lambda c, sep: F.substring(F.coalesce(F.array_join(c, sep), F.lit("")), 1, 2000)
    large = first_match(F.col("images"), lambda x: x["large"] != "")
    return raw.select(
        text("main_category").alias("main_category"), text("parent_asin").alias("parent_asin"), F.trim(text("title")).alias("title"),
        joined("description", " ").alias("description"), joined("features", " | ").alias("features"), F.col("price").try_cast("double").alias("price"),
        F.coalesce("average_rating", F.lit(0.0)).alias("average_rating"), F.coalesce("rating_number", F.lit(0)).cast("bigint").alias("rating_number"),
        text("store").alias("store"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
        element_or(F.col("categories"), 1, "").alias("sub_category"), F.coalesce(large["large"], F.lit("")).alias("image_url"),
    )


def project_reviews(raw: DataFrame) -> DataFrame:
    """Raw review records as rows of interactions: missing ids are '', missing numbers 0, a missing flag false."""
    return raw.select(
        F.coalesce("parent_asin", F.lit("")).alias("parent_asin"), F.coalesce("user_id", F.lit("")).alias("user_id"), F.coalesce("rating", F.lit(0.0)).alias("rating"),
        F.coalesce("timestamp", F.lit(0)).cast("bigint").alias("timestamp_ms"), F.coalesce("helpful_vote", F.lit(0)).cast("bigint").alias("helpful_vote"),
        F.coalesce("verified_purchase", F.lit(False)).alias("verified_purchase"),
    )


def read_reviews(spark: SparkSession, path: str | list[str], items: DataFrame, partitions: int | None = None) -> DataFrame:
    """Interactions of known items from (compressed) JSON lines of reviews; what is no JSON is skipped."""
    rows = project_reviews(read_json_lines(spark, path, "raw_review", partitions))
    return rows.join(items.select("parent_asin").distinct(), "parent_asin", "left_semi")


def read_table(spark: SparkSession, path: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A stage table, checked; only the named columns are read."""
    df = schemas.check(spark.read.parquet(path), name)
    return df.select(*columns) if columns else df


def list_files(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """(path, length) of all files below a folder, without their content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")


def add_file_flags(items: DataFrame, files: DataFrame, path_col: str, least_bytes: int = 100) -> DataFrame:
    """Adds has_image: the file of path_col exists with more than least_bytes; without it the path is ''."""
    there = files.filter(F.col("length") > least_bytes).select(F.regexp_replace("path", "^file:(//)?", "").alias(path_col), F.lit(True).alias("has_image"))
    flagged = items.join(there.dropDuplicates([path_col]), path_col, "left").withColumn("has_image", F.coalesce("has_image", F.lit(False)))
    return flagged.withColumn(path_col, F.when(F.col("has_image"), F.col(path_col)).otherwise(F.lit("")))


def fetch_files(
    todo: DataFrame, fetch: Callable[[str], tuple[int, bytes]], url_col: str = "url", attempts: int = 3, least_bytes: int = 100, in_flight: int = 32, backoff: float = 1.5
) -> DataFrame:
    """todo with (ok, reason, body): each URL fetched in its partition, several at a time, again after server errors and exceptions.

    fetch gives (status, body). Statuses from 500 are tried again, after backoff to the power
    of the attempts so far in seconds; other errors and short bodies fail at once. At most
    in_flight fetches of a partition run together. Nothing is fetched before an action runs.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.schema) + ", ok boolean, reason string, body binary"

    def one(url: str | None) -> tuple[bool, str, bytes | None]:
        reason = "no url"
        for attempt in range(attempts if url else 0):
            if attempt and backoff:
                time.sleep(backoff ** (attempt - 1))
            try:
                status, body = fetch(url)
            except Exception as e:  # noqa: BLE001  # any client error is tried again
                reason = type(e).__name__
                continue
            if status >= 500:
                reason = f"http {status}"
            elif status >= 400:
                return False, f"http {status}", None
            elif len(body) < least_bytes:
                return False, "short body", None
            else:
                return True, "", body
        return False, reason, None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(max(1, in_flight)) as pool:
            for b in batches:
                for at in range(0, b.num_rows, 4 * in_flight):  # bodies of a bounded number of files are held
                    part = b.slice(at, 4 * in_flight)
                    got = list(pool.map(one, part.column(part.schema.get_field_index(url_col)).to_pylist()))
                    flags = [pa.array([g[0] for g in got]), pa.array([g[1] for g in got]), pa.array([g[2] for g in got], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*part.columns, *flags], [*part.schema.names, "ok", "reason", "body"])

    return todo.mapInArrow(work, fields)


def decode_images(items: DataFrame, folder: str, path_col: str, size: int = 224) -> DataFrame:
    """Adds image (height, width, n_channels, data) and placeholder: the decoded file of path_col, which lies below folder.

    Files are decoded in the JVM; data holds rows of pixels, blue first. An item without a
    file, or with one that is no image, gets a grey square of that size and placeholder true,
    so that batches keep their size.
    """
    spark = items.sparkSession
    read = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(folder).select("image.*").filter("height > 0")
    files = read.select(F.regexp_replace("origin", "^file:(//)?", "").alias(path_col), F.struct("height", "width", F.col("nChannels").alias("n_channels"), "data").alias("_image"))
    grey = F.struct(F.lit(size).alias("height"), F.lit(size).alias("width"), F.lit(3).alias("n_channels"), F.unhex(F.repeat(F.lit("80"), size * size * 3)).alias("data"))
    joined = items.join(files, path_col, "left")
    return joined.withColumn("placeholder", F.col("_image").isNull()).withColumn("image", F.coalesce("_image", grey)).drop("_image")
