"""Frequent subsequences with gaps, by last-position induction.

A prefix ends, in a user's sequence, where its earliest occurrence ends. An item extends
the prefix if the item's last position lies behind that end, so the last step needs no
scan of the sequence, only a comparison with a precomputed position. Supports are counted
in each split and added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.shared import materialize

#: A user with more rows than this, and than a share of 1 / MOST_HOT of all rows, is reduced before grouping.
HOT_ROWS = 50_000
#: At most so many users can have a larger share than 1 / MOST_HOT, so the list of them may be broadcast.
MOST_HOT = 10_000


#: Couples of a prefix and an event that are looked at together.
COUPLES = 1 << 20


def extend(
    user: np.ndarray, prefix: np.ndarray, end: np.ndarray, first_event: np.ndarray, n_events: np.ndarray, code: np.ndarray, t: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All (row of the prefix, code, time) of events of the same user behind the prefix's end, in parts of bounded size."""
    n = n_events[user]
    ends = np.cumsum(n)
    lo = 0
    while lo < len(user):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + COUPLES, side="right")))
        m = n[lo:hi]
        row = np.repeat(np.arange(lo, hi), m)
        event = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first_event[user[lo:hi]], m)
        keep = t[event] > end[row]
        yield row[keep], code[event[keep]], t[event[keep]]
        lo = hi


def _profiles(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of a batch of (codes, times) lists: first event and number of events of each user; codes; times, sorted by user, code, time."""
    lists = batch.column(0)
    n = lists.value_lengths().to_numpy()
    flat = lists.flatten()
    code = flat.field("code").to_numpy().astype(np.int64)
    t = flat.field("t").to_numpy().astype(np.int64)
    user = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((t, code, user))
    return np.cumsum(n) - n, n, user, code[order], t[order]


def _count(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def _level(profiles: DataFrame, items: int, patterns: np.ndarray, last: bool) -> DataFrame:
    """(key, n): users of each one-item extension of the patterns; key = index of the pattern * items + item.

    patterns: (index, length) codes, in the order of their index, of frequent patterns.
    """
    length = patterns.shape[1]
    known = [{tuple(p[: k + 1]): i for i, p in enumerate(np.unique(patterns[:, : k + 1], axis=0).tolist())} for k in range(length)]
    known[-1] = {tuple(p): i for i, p in enumerate(patterns.tolist())}
    shared = profiles.sparkSession.sparkContext.broadcast((patterns, known))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pats, index = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            first, n, owner, code, t = _profiles(batch)
            # first and last position of each item of a user: events are sorted by user, code, time
            new = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (np.diff(code) != 0)]) if len(code) else np.array([], int)
            stop = np.r_[new[1:], len(code)] - 1 if len(new) else new
            u, c, end, final = owner[new], code[new], t[new], t[stop]
            per = np.bincount(u, minlength=len(n))
            at = np.cumsum(per) - per
            one = np.array([index[0].get((x,), -1) for x in range(items)])
            keep = one[c] >= 0
            user, pid, reach = u[keep], one[c[keep]], end[keep]
            for k in range(1, length):  # the ends of the known prefixes, shortest first
                lookup = np.full((len(index[k - 1]), items), -1, np.int64)
                for p, i in index[k].items():
                    lookup[index[k - 1][p[:-1]], p[-1]] = i
                found = [(np.zeros(0, np.int64),) * 3]
                for row, nc, nt in extend(user, pid, reach, first, n, code, t):
                    nid = lookup[pid[row], nc]
                    ok = nid >= 0
                    found.append((row[ok], nid[ok], nt[ok]))
                row, nid, nt = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((nt, nid, user[row]))
                row, nid, nt = row[order], nid[order], nt[order]
                head = np.r_[True, (np.diff(user[row]) != 0) | (np.diff(nid) != 0)] if len(row) else np.array([], bool)
                user, pid, reach = user[row[head]], nid[head], nt[head]
            for row, nc, _ in extend(user, pid, reach, at, per, c, final):  # last positions behind the ends
                fresh = (pats[pid[row]] != nc[:, None]).all(axis=1)
                held.append(_count(pid[row[fresh]] * items + nc[fresh]))
                if sum(len(k) for k, _ in held) > 1 << 20:
                    held = [_add(held)]
        keys, counts = _add(held) if held else (np.array([], np.int64), np.array([], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["key", "n"])

    return profiles.select("events").mapInArrow(work, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _add(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, at, np.concatenate([c for _, c in held]))
    return keys, counts


def frequent_sequences(
    rows: DataFrame, length: int = 3, min_users: int = 12, min_share: float = 0.02,
    user_col: str = "user_id", item_col: str = "parent_asin", time_col: str = "timestamp_ms",
) -> DataFrame:
    """(item_1 .. item_length, n_users): sequences of different items that enough users show.

    A user shows a sequence if its items occur at strictly increasing times, with anything
    between them. Only rows with a non-empty user and item and a time above 0 count, for the
    order and for the number of all users; repeated rows count once. Items of equal time have
    no order. An empty table, or one without a frequent sequence, gives no rows.

    The frequent items come to the driver: with a share s and b different items of an average
    user there are at most b / s. So do the frequent prefixes of each length.
    """
    spark = rows.sparkSession
    names = [f"item_{k + 1}" for k in range(length)]
    valid = rows.select(
        F.col(user_col).cast("string").alias("u"), F.col(item_col).cast("string").alias("item"), F.col(time_col).cast("bigint").alias("t")
    ).filter("u <> '' AND item <> '' AND t > 0")
    touched = materialize(valid.groupBy("u", "item").agg(F.count("*").alias("n_rows")))
    users, total = touched.groupBy("u").agg(F.sum("n_rows").alias("r")).agg(F.count("*"), F.coalesce(F.sum("r"), F.lit(0))).first()
    need = max(min_users, int(np.ceil(min_share * users - 1e-9)), 1)
    frequent = [r.item for r in touched.groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= need).orderBy("item").collect()]
    empty = spark.createDataFrame([], ", ".join(f"{n} string" for n in names) + ", n_users bigint")
    if not frequent:
        return empty
    codes = F.broadcast(spark.createDataFrame(list(enumerate(frequent)), "code int, item string"))
    events = valid.join(codes, "item").select("u", "code", "t")

    # hot users: their events are cut down to those that can end a prefix or be an item's last
    hot_rows = max(HOT_ROWS, total // MOST_HOT)
    per_user = touched.join(codes, "item").groupBy("u").agg(F.sum("n_rows").alias("r")).filter(F.col("r") > hot_rows).select("u")
    hot = materialize(per_user)
    few = events
    if not hot.isEmpty():
        events = materialize(events)  # read twice more
        few = materialize(_reduced(events.join(F.broadcast(hot), "u"), length)).select("u", "code", "t")
        few = few.unionByName(events.join(F.broadcast(hot), "u", "left_anti"))
    # repeated rows go as the sets are built, in each split first
    profiles = materialize(few.groupBy("u").agg(F.collect_set(F.struct("code", "t")).alias("events")).select("events"))

    items = len(frequent)
    patterns = np.arange(items)[:, None]
    for k in range(1, length):
        found = _level(profiles, items, patterns, k == length - 1).filter(F.col("n") >= need)
        got = sorted((r.key, r.n) for r in found.collect())  # frequent only, bounded as the items are
        if not got:
            return empty
        keys = np.array([x for x, _ in got])
        patterns = np.column_stack([patterns[keys // items], keys % items])
    out = [(*(frequent[c] for c in p), int(n)) for p, (_, n) in zip(patterns.tolist(), got)]
    return spark.createDataFrame(out, empty.schema)


def _reduced(events: DataFrame, length: int) -> DataFrame:
    """The events that matter, for users with very many: of each item the earliest event behind each
    prefix end, and the last one. Ends of one-item prefixes are the items' first positions; ends of longer
    prefixes are events kept so far, so each round looks behind the events that the last one kept.
    """
    grouped = events.groupBy("u", "code").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    ends = grouped.groupBy("u").agg(F.array_sort(F.collect_set("first")).alias("ends"))
    kept = None
    for k in range(1, max(2, length - 1)):
        marked = events.join(F.broadcast(ends), "u").withColumn("slot", F.expr("size(filter(ends, e -> e < t))"))
        kept = marked.groupBy("u", "code", "slot").agg(F.min("t").alias("t"))
        if k + 1 < length - 1:
            ends = kept.groupBy("u").agg(F.array_sort(F.collect_set("t")).alias("ends"))
    lasts = grouped.select("u", "code", F.col("last").alias("t"))
    return kept.select("u", "code", "t").unionByName(lasts).distinct()
