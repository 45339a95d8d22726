"""Items that appear together: exact pair counts against a fitted bipartite null.

Counts: an item that occurs in fewer baskets than a pair must, or in so many that no pair
with it can reach the wanted ratio, is left out first. The few largest baskets, one fewer
than the baskets a pair must occur in, are never expanded: a pair must occur in one of the
others too, and what the largest add is the overlap of two bit masks. The others are
expanded in blocks of bounded size and counted in each split before the shuffle.

Null: the bipartite configuration model, whose expected item frequencies and basket sizes
are the observed ones. Items of about equal frequency and baskets of about equal size share
a parameter, so it is fitted on these classes, whose number is bounded: frequencies and sizes
up to EXACT are classes of their own, larger ones within a 64th of a power of two (1.1 %) are
one class at their mean. The number of baskets with both items is then
Poisson-binomial; its upper tail comes from a saddlepoint, and false discoveries among all
possible pairs are controlled by the step-up rule on a fine histogram of the tails.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.shared import materialize

#: Items of a basket in a block; pairs are counted block by block.
BLOCK = 512
#: Pairs that a split holds before it adds them up, and numbers of a matrix of pairs and classes.
HELD_PAIRS, HELD_NUMBERS = 1 << 19, 1 << 18
#: Frequencies and sizes that are classes of their own, and classes for each doubling beyond.
EXACT, PER_DOUBLING = 256, 64
#: Bins of the histogram of -log10(tail), each so wide.
BINS, WIDTH = 40_000, 0.01


def fit_null(degrees: np.ndarray, n_items: np.ndarray, sizes: np.ndarray, n_baskets: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Parameters x of the degree classes and y of the size classes: P(item in basket) = xy / (1 + xy)."""
    total = float((degrees * n_items).sum())
    x, y = degrees / np.sqrt(total), sizes / np.sqrt(total)
    for _ in range(rounds):
        x_new = degrees / ((n_baskets * y) / (1 + np.outer(x, y))).sum(axis=1)
        y_new = sizes / ((n_items * x_new) / (1 + np.outer(y, x_new))).sum(axis=1)
        moved = max(np.abs(x_new / x - 1).max(), np.abs(y_new / y - 1).max())
        x, y = x_new, y_new
        if moved < 1e-9:
            break
    else:
        warnings.warn(f"the null still moved by {moved:.1e} of its parameters after {rounds} rounds", stacklevel=2)
    return x, y


def degree_class(d: np.ndarray) -> np.ndarray:
    """The class of each frequency or size: itself up to EXACT, a share of a doubling beyond."""
    d = np.asarray(d, np.float64)
    return np.where(d <= EXACT, d, EXACT + 1 + np.floor(np.log2(np.maximum(d, 1) / EXACT) * PER_DOUBLING)).astype(np.int64)


def upper_tail(n: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """-log10 P(X >= n) of Poisson-binomial variables: m[k] trials of probability q[i, k] each."""
    from math import log

    target = n - 0.5
    mean = (q * m).sum(axis=1)
    most = (m * (q > 0)).sum(axis=1)
    target = np.minimum(target, most - 0.25)
    t = np.log(np.maximum(target, 1e-9) / np.maximum(mean, 1e-300))
    for _ in range(40):
        e = q * np.exp(t)[:, None]
        p = e / (1 - q + e)
        k1 = (p * m).sum(axis=1)
        k2 = (p * (1 - p) * m).sum(axis=1)
        t = np.clip(t - np.clip((k1 - target) / np.maximum(k2, 1e-12), -2, 2), -50, 50)
    e = q * np.exp(t)[:, None]
    p = e / (1 - q + e)
    k0 = (np.log1p(e - q) * m).sum(axis=1)
    k2 = np.maximum((p * (1 - p) * m).sum(axis=1), 1e-12)
    w = np.sqrt(np.maximum(2 * (t * target - k0), 1e-12))
    v = 2 * np.sinh(np.abs(t) / 2) * np.sqrt(k2)
    # log of the Lugannani-Rice tail for t > 0: phi(w) (mills(w) + 1/v - 1/w)
    mills = np.where(w < 8, _mills(np.minimum(w, 8)), 1 / w - 1 / w**3 + 3 / w**5)
    body = np.maximum(mills + 1 / np.maximum(v, 1e-12) - 1 / w, 1e-12)
    out = (w * w / 2 + 0.5 * log(2 * np.pi) - np.log(body)) / log(10)
    return np.where((t <= 1e-6) | (target <= mean), 0.0, np.maximum(out, 0.0))


def _mills(w: np.ndarray) -> np.ndarray:
    """(1 - Phi(w)) / phi(w) for 0 <= w <= 8, by the continued fraction from a fixed depth."""
    out = np.zeros_like(w)
    for k in range(200, 0, -1):
        out = k / (w + out)
    return 1 / np.maximum(w + out, 1e-9)


def _count_blocks(baskets: DataFrame) -> DataFrame:
    """(a, b, n) with a < b from rows (left, right): all pairs within left if right is null, else between both."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_held: list[np.ndarray] = []
        b_held: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            a, b = np.concatenate(a_held), np.concatenate(b_held)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            head = np.flatnonzero(np.r_[True, (np.diff(a) != 0) | (np.diff(b) != 0)])
            n = np.diff(np.r_[head, len(a)])
            a_held.clear()
            b_held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a[head]), pa.array(b[head]), pa.array(n.astype(np.int64))], ["a", "b", "n"])

        triangles = {}
        for batch in batches:
            left, right = batch.column(0), batch.column(1)
            flat = left.flatten().to_numpy()
            n = left.value_lengths().to_numpy()
            at = np.cumsum(n) - n
            single = right.is_null().to_numpy(zero_copy_only=False)
            for size in np.unique(n[single & (n > 1)]).tolist():  # baskets of equal size at once
                if size not in triangles:
                    triangles[size] = np.triu_indices(size, 1)
                i, j = triangles[size]
                rows = at[single & (n == size)]
                step = max(1, HELD_PAIRS // len(i))
                for k in range(0, len(rows), step):
                    base = rows[k : k + step, None]
                    a_held.append(flat[base + i].ravel())
                    b_held.append(flat[base + j].ravel())
                    held += a_held[-1].size
                    if held > HELD_PAIRS:
                        yield flush()
                        held = 0
            for r in np.flatnonzero(~single).tolist():
                x = flat[at[r] : at[r] + n[r]]
                y = np.array(right[r].as_py(), np.int64)
                a_held.append(np.minimum(x[:, None], y[None, :]).ravel())
                b_held.append(np.maximum(x[:, None], y[None, :]).ravel())
                held += a_held[-1].size
                if held > HELD_PAIRS:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    return baskets.mapInArrow(work, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def pair_counts(
    rows: DataFrame, min_count: int = 20, min_ratio: float = 4.0, user_col: str = "user_id", item_col: str = "parent_asin", surprise: bool = True
) -> DataFrame:
    """(asin_a, asin_b, n_ab, n_a, n_b, ratio[, tail, q_value, expected]) with asin_a < asin_b.

    A basket is the set of items of one user, from rows with non-empty user and item;
    repeated rows count once. Pairs with n_ab >= min_count baskets and ratio = n_ab N / (n_a n_b)
    >= min_ratio come out, all of them, with exact counts. expected is the count under the
    fitted null, tail is -log10 of the chance of n_ab or more, q_value the false-discovery rate
    (an upper bound, 0.02 of a decimal power wide) at which the pair counts as a surprise. An
    empty table gives no rows.
    """
    spark = rows.sparkSession
    member = materialize(
        rows.select(F.col(user_col).cast("string").alias("u"), F.col(item_col).cast("string").alias("item"))
        .filter("u <> '' AND item <> ''")
        .distinct()
    )
    n_baskets = member.groupBy("u").agg(F.lit(1)).count()
    stats = member.groupBy("item").agg(F.count("*").alias("n_item"))
    items = materialize(
        stats.filter((F.col("n_item") >= min_count) & (F.col("n_item") * F.lit(float(min_ratio)) <= n_baskets)).withColumn("id", F.monotonically_increasing_id())
    )
    kept = materialize(member.join(items.select("item", "id"), "item").select("u", "id"))
    sizes = kept.groupBy("u").agg(F.count("*").alias("n"))
    # one fewer than a pair needs: a pair of the largest baskets alone can't be a case
    largest = [r.u for r in sizes.filter(F.col("n") > BLOCK // 4).orderBy(F.desc("n"), "u").limit(min(max(min_count - 1, 0), 62)).collect()]
    few = spark.createDataFrame(list(enumerate(largest)), "bit int, u string")
    others = kept.join(F.broadcast(few.select("u")), "u", "left_anti") if largest else kept
    per = sizes.filter(F.col("n") > BLOCK)
    in_blocks = (
        others.join(per.withColumn("blocks", F.ceil(F.col("n") / BLOCK)).select("u", "blocks"), "u", "left")
        .withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int"))
        .groupBy("u", "block")
        .agg(F.sort_array(F.collect_list("id")).alias("left"), F.first("blocks").alias("blocks"))
    )
    in_blocks = materialize(in_blocks)
    alone = in_blocks.filter(F.size("left") > 1).select("left", F.lit(None).cast("array<bigint>").alias("right"))
    big = in_blocks.filter("blocks IS NOT NULL")
    across = big.alias("x").join(big.alias("y"), (F.col("x.u") == F.col("y.u")) & (F.col("x.block") < F.col("y.block"))).select("x.left", F.col("y.left").alias("right"))
    light = _count_blocks(alone.unionByName(across)).filter(F.col("n") >= max(1, min_count - len(largest)))
    mask = kept.join(F.broadcast(few), "u").groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    item = items.join(mask, "id", "left").select("id", "item", "n_item", F.coalesce("mask", F.lit(0)).cast("bigint").alias("mask"))
    side = lambda s: item.select(*(F.col(c).alias(f"{c}_{s}") for c in item.columns))
    both = light.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    out = both.select(
        F.least("item_a", "item_b").alias("asin_a"),
        F.greatest("item_a", "item_b").alias("asin_b"),
        (F.col("n") + F.bit_count(F.col("mask_a").bitwiseAND(F.col("mask_b")))).cast("bigint").alias("n_ab"),
        F.when(F.col("item_a") < F.col("item_b"), F.col("n_item_a")).otherwise(F.col("n_item_b")).alias("n_a"),
        F.when(F.col("item_a") < F.col("item_b"), F.col("n_item_b")).otherwise(F.col("n_item_a")).alias("n_b"),
    ).withColumn("ratio", F.col("n_ab") * F.lit(float(n_baskets)) / (F.col("n_a") * F.col("n_b")))
    out = out.filter((F.col("n_ab") >= min_count) & (F.col("ratio") >= min_ratio))
    return _surprise(out, member, n_baskets) if surprise else out


def _surprise(pairs: DataFrame, member: DataFrame, n_baskets: int) -> DataFrame:
    """Adds expected, tail and q_value under the null fitted to all items and baskets."""
    spark = pairs.sparkSession
    number = F.when(F.col("d") <= EXACT, F.col("d")).otherwise(EXACT + 1 + F.floor(F.log2(F.col("d") / EXACT) * PER_DOUBLING)).cast("bigint")

    def classes(key: str) -> list[tuple[int, float, int]]:
        """(class, mean degree, members): at most EXACT + 64 * PER_DOUBLING rows, whatever the data."""
        degrees = member.groupBy(key).agg(F.count("*").alias("d"))
        return sorted(tuple(r) for r in degrees.groupBy(number.alias("c")).agg(F.avg("d"), F.count("*")).collect())

    by_item, by_basket = classes("item"), classes("u")
    out_type = pairs.schema.simpleString()[7:-1].replace(":", " ") + ", expected double, tail double"
    if not by_item:
        return pairs.select("*", F.lit(0.0).alias("expected"), F.lit(0.0).alias("tail"), F.lit(1.0).alias("q_value"))
    item_class, degrees, n_items = (np.array(x, np.float64) for x in zip(*by_item))
    _, sizes, n_of = (np.array(x, np.float64) for x in zip(*by_basket))
    x, y = fit_null(degrees, n_items, sizes, n_of)
    shared = spark.sparkContext.broadcast((item_class.astype(np.int64), x, y, n_of))

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, xs, ys, m = shared.value
        step = max(1, HELD_NUMBERS // len(m))
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                n_a, n_b = (np.searchsorted(numbers, degree_class(part.column(c).to_numpy())) for c in ("n_a", "n_b"))
                pa_, pb_ = (xs[i][:, None] * ys / (1 + xs[i][:, None] * ys) for i in (n_a, n_b))
                q = pa_ * pb_
                tail = upper_tail(part.column("n_ab").to_numpy().astype(float), q, m)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array((q * m).sum(axis=1)), pa.array(tail)], [*part.schema.names, "expected", "tail"])

    scored = materialize(pairs.mapInArrow(tails, out_type))
    bins = dict(
        (int(r.bin), r.n) for r in scored.groupBy(F.least(F.floor(F.col("tail") / WIDTH), F.lit(BINS)).alias("bin")).agg(F.count("*").alias("n")).collect()
    )  # at most BINS + 1 rows
    tests = float(n_items.sum()) * (float(n_items.sum()) - 1) / 2
    rank, table, best = 0, [], 1.0
    for b in sorted(bins, reverse=True):
        rank += bins[b]
        table.append([b, tests * 10.0 ** (-b * WIDTH) / rank])
    for row in reversed(table):  # step up: no pair has a larger rate than a less surprising one
        best = row[1] = min(best, row[1])
    rates = spark.createDataFrame([(b, float(q)) for b, q in table], "bin bigint, q_value double")
    return scored.withColumn("bin", F.least(F.floor(F.col("tail") / WIDTH), F.lit(BINS)).cast("bigint")).join(F.broadcast(rates), "bin").drop("bin")
