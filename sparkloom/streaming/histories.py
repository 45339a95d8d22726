"""Streaming forms of the history operators. An extension: the batch forms are the definition."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_last_events(events: DataFrame, n: int = 50) -> DataFrame:
    """(user_id, chain) after each micro-batch: the last n items of every user that had events in it.

    events: user_id, item_id, timestamp_ms, ordinal (all bigint). The state of a user is bounded
    by n events, so events may arrive in any order; late ones take their place by time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = [tuple(x) for x in json.loads(state.get[0])] if state.exists else []
        for pdf in batches:
            fresh = list(zip(pdf.timestamp_ms.tolist(), pdf.ordinal.tolist(), pdf.item_id.tolist()))
            kept = sorted({*kept, *fresh})[-n:]
        state.update((json.dumps(kept),))
        yield pd.DataFrame({"user_id": [key[0]], "chain": [[x[2] for x in kept]]})

    slim = events.select("user_id", "item_id", "timestamp_ms", "ordinal")
    return slim.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, chain array<bigint>", "kept string", "update", GroupStateTimeout.NoTimeout)


def stream_window_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, key, n): events of each key in tumbling windows, with a bound on lateness."""
    windowed = events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
    return windowed.select(F.col("window.start").alias("start"), key, "n")
