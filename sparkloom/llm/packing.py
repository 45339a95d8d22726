"""Filling containers of fixed capacity with documents by a linear grouping scheme.

All planning is on the histogram of sizes, which has at most one entry for each size up
to the capacity and so does not grow with the corpus. Large sizes are cut into groups of
equal cardinality and rounded up to the largest of their group; a linear programme over
all configurations of these few sizes gives how many containers of each configuration
to fill. The rounded slots, but the smallest of each container, are then replaced by
actual sizes, and what is left over and all small sizes go by best fit, again as counts,
into the space that remains. The plan
says which ranks of a size go to which containers; documents find their container by
their rank among those of equal size, which is computed in parallel.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.shared import materialize

#: A size is large from one of these fractions of the capacity, whichever needs the fewest containers; 1 / 5
#: bounds a configuration to four parts.
LARGE = (1 / 5, 1 / 4, 1 / 3, 1 / 2)
#: Groups of large sizes; bounds the configurations (at most C(groups + 4, 4)).
GROUPS = 14
#: Documents of equal size that are ranked together; a common size is divided among as many tasks as it needs.
RANKED = 1 << 17


@dataclass
class Run:
    """Ranks lo.. of a size, n of them, put per container into containers from start on."""

    size: int
    lo: int
    n: int
    start: int
    per: int


def group_sizes(sizes: np.ndarray, counts: np.ndarray, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of nearly equal cardinality in falling order of size: (rounded size, [(size, count)]).

    A size may be divided between two groups.
    """
    total = int(counts.sum())
    if not total:
        return []
    each = -(-total // groups)
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for s, c in sorted(zip(sizes.tolist(), counts.tolist()), reverse=True):
        while c:
            if not room:
                out.append((s, []))
                room = each
            take = min(c, room)
            out[-1][1].append((s, take))
            c -= take
            room -= take
    return out


def configurations(sizes: list[int], capacity: int) -> np.ndarray:
    """All maximal multisets of the sizes (in falling order) that fit the capacity, one row each."""
    out: list[list[int]] = []

    def extend(k: int, left: int, row: list[int]) -> None:
        if k == len(sizes):
            if not any(s <= left for s in sizes):
                out.append(row)
            return
        for n in range(left // sizes[k], -1, -1):
            extend(k + 1, left - n * sizes[k], [*row, n])

    extend(0, capacity, [])
    return np.array(out, np.float64)


def solve(patterns: np.ndarray, demand: np.ndarray) -> dict[int, int]:
    """Rounded-down solution of min sum(x), patterns.T @ x >= demand, by column generation.

    The revised simplex keeps a basis of as many configurations as sizes; entering
    columns are priced against all configurations at once.
    """
    k = len(demand)
    basis = np.zeros((k, k))
    which = [-1] * k
    for i in range(k):
        j = int(np.argmax(patterns[:, i]))
        basis[i, i] = patterns[j, i]  # a configuration of one size only, completed below
    step = 0
    while True:
        y = np.linalg.solve(basis.T, np.ones(k))
        value = patterns @ y
        # the best configuration enters; after many steps the first that improves, which can't go round in a circle
        j = int(np.argmax(value)) if step < 60 * k else int(np.argmax(value > 1 + 1e-9))
        if value[j] <= 1 + 1e-9:
            break
        step += 1
        x = np.linalg.solve(basis, demand)
        d = np.linalg.solve(basis, patterns[j])
        ratio = np.where(d > 1e-12, x / np.where(d > 1e-12, d, 1), np.inf)
        r = int(np.argmin(ratio))
        basis[:, r] = patterns[j]
        which[r] = j
    x = np.linalg.solve(basis, demand)
    out: dict[int, int] = {}
    for col, n in zip(range(k), np.floor(x + 1e-9).astype(int).tolist()):
        if which[col] >= 0 and n > 0:
            out[which[col]] = out.get(which[col], 0) + n
    return out


def plan(sizes: list[int], counts: list[int], capacity: int, groups: int = GROUPS, large: tuple[float, ...] = LARGE) -> tuple[list[Run], int]:
    """The runs for a histogram of sizes in 1..capacity, and the number of containers, for the best of the limits of large sizes."""
    return min((plan_from(sizes, counts, capacity, groups, x) for x in large), key=lambda p: p[1])


def plan_from(sizes: list[int], counts: list[int], capacity: int, groups: int, large: float) -> tuple[list[Run], int]:
    """The plan that takes sizes from this fraction of the capacity for large."""
    hist = dict(zip(sizes, counts))
    used = dict.fromkeys(hist, 0)
    runs: list[Run] = []
    opened = 0
    spaces: dict[int, list[tuple[int, int]]] = {}  # residual -> [(first container, how many)]
    free: list[int] = []

    def keep(residual: int, start: int, n: int) -> None:
        if n and residual:
            if residual not in spaces:
                spaces[residual] = []
                bisect.insort(free, residual)
            spaces[residual].append((start, n))

    big = [s for s in sizes if s >= large * capacity and s < capacity]
    grouped = group_sizes(np.array(big, np.int64), np.array([hist[s] for s in big], np.int64), groups)
    if grouped:
        rounded = [g for g, _ in grouped]
        demand = np.array([sum(c for _, c in m) for _, m in grouped], np.float64)
        merged: dict[int, int] = {}
        for i, s in enumerate(rounded):
            merged.setdefault(s, i)  # groups of equal rounded size are one size of the programme
        distinct = list(merged)
        need = np.array([sum(d for s, d in zip(rounded, demand) if s == t) for t in distinct])
        queue = {t: [x for s, m in grouped if s == t for x in m] for t in distinct}
        patterns = configurations(distinct, capacity)
        left = need.astype(int)
        for j, n in sorted(solve(patterns, need).items()):
            row = patterns[j].astype(int)
            while n:
                full = min([n, *(int(left[i]) // int(a) for i, a in enumerate(row) if a)])
                m = full or 1  # the last containers of a configuration may lack some of its parts
                fill = [min(int(a), int(left[i])) if not full else int(a) for i, a in enumerate(row)]
                if sum(fill) > 1:  # the smallest part is left to the best fit, which also uses what rounding wastes
                    fill[max(i for i, a in enumerate(fill) if a)] -= 1
                if not any(fill):
                    break
                used_up = np.zeros(m, np.int64)
                for i, a in enumerate(fill):
                    for _ in range(a):
                        at = 0
                        while at < m:  # substitute actual sizes for the rounded slot
                            s, c = queue[distinct[i]][0]
                            take = min(c, m - at)
                            runs.append(Run(s, used[s], take, opened + at, 1))
                            used[s] += take
                            used_up[at : at + take] += s
                            at += take
                            queue[distinct[i]][0] = (s, c - take)
                            if c == take:
                                queue[distinct[i]].pop(0)
                    left[i] -= a * m
                cut = np.flatnonzero(np.diff(used_up)) + 1
                for a, b in zip([0, *cut.tolist()], [*cut.tolist(), m]):
                    keep(capacity - int(used_up[a]), opened + a, b - a)
                opened += m
                n -= m
    for s in sorted(hist, reverse=True):  # best fit; equal sizes fill a container one after the other
        c = hist[s] - used[s]
        while c:
            at = bisect.bisect_left(free, s)
            if at == len(free):
                per = capacity // s
                n, rest = divmod(c, per)
                for k, items in ((n, per), (1 if rest else 0, rest)):
                    if k:
                        runs.append(Run(s, used[s], k * items, opened, items))
                        used[s] += k * items
                        keep(capacity - items * s, opened, k)
                        opened += k
                c = 0
                continue
            residual = free[at]
            start, n = spaces[residual].pop()
            if not spaces[residual]:
                del spaces[residual]
                free.pop(at)
            per = residual // s
            k = min(n, c // per)
            if k:
                runs.append(Run(s, used[s], k * per, start, per))
                used[s] += k * per
                keep(residual - per * s, start, k)
                c -= k * per
            if k < n and c:  # fewer than per are left
                runs.append(Run(s, used[s], c, start + k, c))
                used[s] += c
                keep(residual - c * s, start + k, 1)
                k, c = k + 1, 0
            keep(residual, start + k, n - k)
    return runs, opened


def pack(
    sizes: DataFrame, limits: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens",
    groups: int = GROUPS, large: tuple[float, ...] = LARGE, ranked: int = RANKED,
) -> DataFrame:
    """(pack_name, container_id, doc_id, part, first_token, n_tokens): where each document goes.

    sizes: one row for each document; limits: (pack_name, capacity), a small table of
    settings, each of which is a packing of all documents of its own. A document goes
    whole into one container; only one that exceeds the capacity is cut, into parts of the
    capacity and a rest, numbered from 0. container_id counts from 0 within a pack_name.
    A document without tokens (null or 0) needs no container: its one row has a null
    container_id and n_tokens 0. Repeated rows are packed as often as they occur. An
    empty table gives no rows.
    """
    spark = sizes.sparkSession
    caps = [(r[0], int(r[1])) for r in limits.select("pack_name", "capacity").distinct().orderBy("pack_name").collect()]
    settings = spark.createDataFrame(caps, "pack_name string, capacity int")
    items = (
        sizes.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(size_col), F.lit(0)).cast("bigint").alias("size"))
        .crossJoin(F.broadcast(settings))  # one row for each setting
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("size") / F.col("capacity")) - 1, F.lit(0).cast("bigint")))))
        .select(
            "pack_name", "doc_id", F.col("part").cast("int").alias("part"),
            (F.col("part") * F.col("capacity")).alias("first_token"),
            F.least(F.col("capacity").cast("bigint"), F.col("size") - F.col("part") * F.col("capacity")).cast("int").alias("n_tokens"),
        )
    )
    items = materialize(items)
    hist = items.filter("n_tokens > 0").groupBy("pack_name", "n_tokens").agg(F.count("*").alias("n")).collect()  # at most one row for each size
    divided = [(r.pack_name, r.n_tokens, -(-r.n // ranked)) for r in hist if r.n > ranked]
    divided = spark.createDataFrame(divided, "pack_name string, n_tokens int, buckets bigint")
    bucket = F.pmod(F.xxhash64("doc_id", "part"), F.coalesce("buckets", F.lit(1))).cast("int").alias("bucket")
    items = items.join(F.broadcast(divided), ["pack_name", "n_tokens"], "left").select("pack_name", "doc_id", "part", "first_token", "n_tokens", bucket)
    per_bucket = materialize(items.filter("n_tokens > 0").groupBy("pack_name", "n_tokens", "bucket").agg(F.count("*").alias("n")))
    runs: dict[str, list[Run]] = {}
    for name, cap in caps:
        own = sorted((r.n_tokens, r.n) for r in hist if r.pack_name == name)
        runs[name] = plan([s for s, _ in own], [n for _, n in own], cap, groups, large)[0]
    lookup = {}
    for name, rs in runs.items():
        rs.sort(key=lambda r: (r.size, r.lo))
        lookup[name] = tuple(np.array([getattr(r, f) for r in rs], np.int64) for f in ("size", "lo", "start", "per"))
    shared = spark.sparkContext.broadcast(lookup)  # a few entries for each size up to the capacity

    # ranks among equal sizes: an offset for each bucket, and a window within the bucket
    from pyspark.sql import Window as W

    ahead = W.partitionBy("pack_name", "n_tokens").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.select("pack_name", "n_tokens", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    within = W.partitionBy("pack_name", "n_tokens", "bucket").orderBy("doc_id", "part")
    ranked = (
        items.withColumn("rank", F.row_number().over(within).cast("bigint") - 1)
        .join(offsets, ["pack_name", "n_tokens", "bucket"], "left")
        .select("pack_name", "doc_id", "part", "first_token", "n_tokens", (F.col("rank") + F.coalesce("ahead", F.lit(0))).alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for b in batches:
            names = b.column("pack_name").to_numpy(zero_copy_only=False)
            size = b.column("n_tokens").to_numpy().astype(np.int64)
            rank = b.column("rank").to_numpy()
            at = np.full(len(names), -1, np.int64)
            for name in set(names.tolist()):
                rows = np.flatnonzero((names == name) & (size > 0))
                s, lo, start, per = tables[name]
                if not len(rows) or not len(s):
                    continue
                k = np.searchsorted(s * (1 << 42) + lo, size[rows] * (1 << 42) + rank[rows], side="right") - 1
                at[rows] = start[k] + (rank[rows] - lo[k]) // per[k]
            yield pa.RecordBatch.from_arrays(
                [b.column("pack_name"), pa.array(at, mask=at < 0), *(b.column(c) for c in ("doc_id", "part", "first_token", "n_tokens"))],
                ["pack_name", "container_id", "doc_id", "part", "first_token", "n_tokens"],
            )

    return ranked.mapInArrow(place, "pack_name string, container_id bigint, doc_id bigint, part int, first_token bigint, n_tokens int")
