"""Totals per key without per-key tasks: dense accumulator arrays.

Each input split encodes its own keys as a dictionary and reduces its rows into
arrays over that dictionary (bincount and scatter reductions). The arrays are cut
into blocks by the hash of the key, and equal blocks are added up in a distributed
reduction. However many rows a key has, it is one array cell of each split, so a
hot key costs what a cold one costs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a split gathers before it encodes them; bounds its memory.
CHUNK_ROWS = 1 << 19
#: Rows of the table for each array block; bounds the cells that a block gets from all splits together.
BLOCK_ROWS = 1 << 20

_PARTIAL = (
    "key_field string, block int, key_value array<string>, n_rows array<bigint>, n_rated array<bigint>, "
    "rating_sum array<double>, helpful_votes array<bigint>, first_ms array<bigint>, last_ms array<bigint>"
)
TOTALS = (
    "key_field string, key_value string, n_rows bigint, n_rated bigint, rating_sum double, "
    "helpful_votes bigint, first_ms bigint, last_ms bigint"
)
_NONE_MIN, _NONE_MAX = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _scatter(codes: np.ndarray, size: int, cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Adds, or takes the least or greatest of, each column's values at its rows' codes."""
    out = {}
    for name, values in cols.items():
        if name == "first_ms":
            acc = np.full(size, _NONE_MIN)
            np.minimum.at(acc, codes, values)
        elif name == "last_ms":
            acc = np.full(size, _NONE_MAX)
            np.maximum.at(acc, codes, values)
        elif values.dtype == np.float64:
            acc = np.bincount(codes, weights=values, minlength=size)
        else:
            acc = np.zeros(size, np.int64)
            np.add.at(acc, codes, values)
        out[name] = acc
    return out


def _encode(keys: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Codes and dictionary of the keys; null is a key of its own."""
    enc = keys.dictionary_encode(null_encoding="encode")
    if isinstance(enc, pa.ChunkedArray):
        enc = enc.combine_chunks()
        if isinstance(enc, pa.ChunkedArray):
            enc = enc.chunk(0)
    return enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), enc.dictionary


def _numbers(col: pa.ChunkedArray, fill, dtype) -> np.ndarray:
    return col.fill_null(fill).to_numpy().astype(dtype, copy=False)


def _reduce_split(table: pa.Table, key_fields: list[str], blocks: int) -> Iterator[pa.RecordBatch]:
    rating = table.column("rating")
    ms = table.column("timestamp_ms")
    cols = {
        "n_rows": np.ones(len(table), np.int64),
        "n_rated": rating.is_valid().to_numpy().astype(np.int64),
        "rating_sum": _numbers(rating, 0.0, np.float64),
        "helpful_votes": _numbers(table.column("helpful_vote"), 0, np.int64),
        "first_ms": _numbers(ms, _NONE_MIN, np.int64),
        "last_ms": _numbers(ms, _NONE_MAX, np.int64),
    }
    for field in key_fields:
        codes, keys = _encode(table.column(field))
        acc = _scatter(codes, len(keys), cols)
        block = (pd.util.hash_array(keys.fill_null("").to_numpy(zero_copy_only=False)) % np.uint64(blocks)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        which, at = np.unique(block[order], return_index=True)
        offsets = pa.array(np.append(at, len(order)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, keys.take(pa.array(order)))]
        lists += [pa.ListArray.from_arrays(offsets, pa.array(acc[c][order])) for c in cols]
        yield pa.RecordBatch.from_arrays(
            [pa.array([field] * len(which)), pa.array(which), *lists], ["key_field", "block", "key_value", *cols]
        )


def _add_blocks(table: pa.Table) -> pa.Table:
    flat = {c: table.column(c).combine_chunks() for c in table.column_names}
    flat = {c: (v.chunk(0) if isinstance(v, pa.ChunkedArray) else v) for c, v in flat.items()}
    codes, keys = _encode(flat["key_value"].flatten())
    names = ["n_rows", "n_rated", "rating_sum", "helpful_votes", "first_ms", "last_ms"]
    acc = _scatter(codes, len(keys), {c: flat[c].flatten().to_numpy() for c in names})
    out = {"key_field": pa.repeat(flat["key_field"][0], len(keys)), "key_value": keys}
    for c in names:
        none = acc[c] == {"first_ms": _NONE_MIN, "last_ms": _NONE_MAX}.get(c, -1) if c.endswith("_ms") else None
        out[c] = pa.array(acc[c], mask=none)
    return pa.table(out)


def dense_totals(rows: DataFrame, key_fields: list[str], blocks: int | None = None) -> DataFrame:
    """Totals per value of each key field, as TOTALS.

    rows needs the key fields (strings), rating, helpful_vote and timestamp_ms; other
    columns are ignored, whatever their names. blocks: array blocks of each key field; by
    default as many as the table has BLOCK_ROWS, and one for each shuffle partition at least,
    so that a block gets about BLOCK_ROWS cells at most from all splits together even if no
    key occurs twice.

    Null and empty keys are keys like any other. A null rating counts in n_rows but not in
    n_rated; a null helpful_vote counts 0; a key without any timestamp has null first_ms and
    last_ms. Repeated rows count each time. An empty table gives no rows.
    """
    spark = rows.sparkSession
    if blocks is None:
        blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BLOCK_ROWS))
    slim = rows.select(
        *(F.col(k).cast("string").alias(k) for k in key_fields),
        F.col("rating").cast("double").alias("rating"),
        F.col("helpful_vote").cast("bigint").alias("helpful_vote"),
        F.col("timestamp_ms").cast("bigint").alias("timestamp_ms"),
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK_ROWS:
                yield from _reduce_split(pa.Table.from_batches(held), key_fields, blocks)
                held, n = [], 0
        if n:
            yield from _reduce_split(pa.Table.from_batches(held), key_fields, blocks)

    partial = slim.mapInArrow(split, _PARTIAL)
    return partial.groupBy("key_field", "block").applyInArrow(_add_blocks, TOTALS)


def heavy_keys(rows: DataFrame, key_fields: list[str], share: float = 0.03) -> DataFrame:
    """(key_field, key_value) of the values that hold at least that share of all rows.

    Null and empty keys count among all rows but are no result.
    """
    from sparkloom.shared import materialize

    totals = materialize(dense_totals(rows, key_fields).select("key_field", "key_value", "n_rows"))
    every = totals.groupBy("key_field").agg(F.sum("n_rows").alias("n_all"))
    return (
        totals.join(F.broadcast(every), "key_field")  # one row for each key field
        .filter("key_value <> '' AND n_rows >= n_all * {}".format(share))
        .select("key_field", "key_value")
    )
