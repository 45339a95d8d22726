"""Listings of the same product among wordings, units, orders and sales phrases.

Listings that say the same in canonical form are one class, so a product with very many
listings is few classes. Classes are blocked on rare words: words of at most a bounded
number of classes that go with one brand only, such as names of product lines, in a form
that swapped letters don't change. A word of more classes blocks together with each other
word of the class, so that no class is lost. Pairs of a block are vetoed by arrays, all at
once, where they state different brands, kinds, sizes, colours, counts or models; what is
left is confirmed by the cosine of the names' character n-grams, weighted by inverse
frequency, expanded to keys, and clustered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.components import connected_components
from sparkloom.llm.titles import COLOURS, MEASURES, NUMBER_WORDS, UNITS, attributes, canonical_words, plain
from sparkloom.shared import materialize, release

#: Length of the n-grams and the cosine from which a pair is confirmed.
GRAM, LEAST_COSINE = 3, 0.35
#: Share of a word's branded listings that must be of one brand for the word to be a line's name.
ONE_BRAND = 0.8
#: Classes that a word may have to be rare.
RARE = 512
#: Buckets of n-grams whose frequencies are kept.
GRAM_BUCKETS = 1 << 16
#: Classes of a block that are compared at once, and pairs that are looked at together.
BLOCK, PAIRS = 512, 1 << 20
#: Measures of the same thing may differ by rounding, by so much of the larger one.
SLACK = 0.03
_COUNT_WORDS = frozenset("pack set of single pcs pc pk count piece pieces finish by for with and".split())
_STATED = ("colour", "count", "model")


def _name_words(title: str | None, flat: str | None = None) -> list[str]:
    """Words of letters that are no colour, count or unit."""
    return [w for w in canonical_words(title, flat) if len(w) > 2 and w.isalpha() and w not in COLOURS and w not in NUMBER_WORDS and w not in UNITS and w not in _COUNT_WORDS]


def _brand(flat_features: str, store: str | None, words: list[str]) -> str | None:
    """The brand that the features state, or else the store, where its name stands in the title (a brand that sells its own)."""
    for part in flat_features.split("|"):
        key, _, value = part.strip().partition(":")
        if key.strip() in ("brand", "manufacturer") and value.strip():
            return " ".join(value.split())
    own = plain(store).split()
    return " ".join(own) if own and set(own) <= set(words) else None


def _number(text: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


_KNOWN: dict[str, list[int]] = {}
MOST_KNOWN = 1 << 15


def _grams(words: list[str]) -> list[int]:
    """Buckets of the n-grams of the words; those of words that were seen lately are remembered."""
    from xxhash import xxh3_64_intdigest

    out: set[int] = set()
    for w in words:
        own = _KNOWN.get(w)
        if own is None:
            if len(_KNOWN) >= MOST_KNOWN:
                _KNOWN.clear()
            edged = f" {w} "
            own = _KNOWN[w] = [xxh3_64_intdigest(edged[i : i + GRAM].encode("utf-8", "surrogatepass")) % GRAM_BUCKETS for i in range(max(1, len(edged) + 1 - GRAM))]
        out.update(own)
    return sorted(out)


_RECORD = pa.schema(
    [("class", pa.int64()), ("words", pa.list_(pa.string())), ("brand", pa.string()), ("kind", pa.string()), ("brand_no", pa.int64()), ("kind_no", pa.int64()), ("grams", pa.list_(pa.int32()))]
    + [(k, pa.list_(pa.int64())) for k in _STATED] + [(k, pa.list_(pa.float64())) for k in MEASURES]
)
_CLASS = "class bigint, words array<string>, brand string, kind string, brand_no bigint, kind_no bigint, grams array<int>, " + ", ".join([*(f"{k} array<bigint>" for k in _STATED), *(f"{k} array<double>" for k in MEASURES)])


def classes(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of listings with a title, and (parent_asin, class)."""
    schema = pa.schema([pa.field("parent_asin", pa.string()), *_RECORD])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: list = []
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for asin, title, features, store, kind in zip(*(c.to_pylist() for c in b.columns)):
                flat = plain(title), plain(features)
                words = _name_words(title, flat[0])
                if not words:
                    continue
                stated = {k: sorted(v) for k, v in attributes(title, features, flat).items()}
                brand = _brand(flat[1], store, words)
                values = [asin, _number(repr((sorted(words), brand, kind, sorted(stated.items())))), words, brand, kind, *(None if x is None else _number(x) for x in (brand, kind)), _grams(words)]
                values += [[x if isinstance(x, int) else _number(x) for x in stated[k]] if k in stated else none for k in _STATED]
                values += [stated.get(k, none) for k in MEASURES]
                for column, x in zip(out.values(), values):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    slim = items.select(
        F.col("parent_asin").cast("string").alias("parent_asin"), "title", "features", "store",
        F.when(F.size("categories") >= 3, F.lower(F.trim(F.get("categories", F.size("categories") - 1)))).alias("kind"),
    ).filter("parent_asin <> ''")
    listed = materialize(slim.mapInArrow(read, "parent_asin string, " + _CLASS))
    rest = [c for c in listed.columns if c not in ("parent_asin", "class")]
    # listings of a class differ in the order of their words only; the first order stands for all
    made = materialize(listed.groupBy("class").agg(F.min_by(F.struct(*rest), F.concat_ws(" ", "words")).alias("x")).select("class", "x.*"))
    keys = materialize(listed.select("parent_asin", "class").distinct())
    release(listed)
    return made, keys


def line_words(made: DataFrame) -> DataFrame:
    """(class, word, alone, likely_no): words that tell lines of products apart.

    These are words that go with one brand, likely_no, or with none that is known, and are no
    brand's or kind's name. alone: the word is rare or a brand's own, and so may block by itself.
    """
    words = made.select("class", "brand_no", F.explode(F.array_distinct("words")).alias("word"))
    brands = made.filter("brand IS NOT NULL").select(F.explode(F.split("brand", " ")).alias("word"))
    kinds = made.filter("kind IS NOT NULL").select(F.explode(F.split("kind", r"\W+")).alias("word"))
    by_brand = words.groupBy("word", "brand_no").agg(F.count("*").alias("n"))
    known = F.when(F.col("brand_no").isNotNull(), F.col("n"))
    per_word = by_brand.groupBy("word").agg(
        F.sum("n").alias("df"), F.max(known).alias("most"), F.sum(known).alias("of_brands"),
        F.max_by("brand_no", F.when(F.col("brand_no").isNotNull(), F.struct("n", "brand_no"))).alias("likely_no"),
    )
    lines = per_word.filter(F.col("most").isNull() | (F.col("most") >= ONE_BRAND * F.col("of_brands")))
    lines = lines.join(brands.unionByName(kinds).distinct(), "word", "left_anti")
    lines = lines.select("word", (F.col("most").isNotNull() | (F.col("df") <= RARE)).alias("alone"), "likely_no")
    return words.join(lines, "word").select("class", "word", "alone", "likely_no")


def blocked(made: DataFrame) -> DataFrame:
    """(class, block, likely_no): the blocks of each class.

    A word is spelt by its sorted letters, so that swapped ones meet. A frequent word without
    a brand blocks together with each other word of the class, so that no class is left out.
    """
    spelt = F.array_join(F.array_sort(F.split("word", "")), "")
    lines = materialize(line_words(made).withColumn("spelt", spelt))
    alone = lines.filter("alone").select("class", F.xxhash64("spelt").alias("block"), "likely_no")
    often = lines.filter("NOT alone").select("class", F.col("spelt").alias("first"))
    every = made.select("class", F.explode(F.array_distinct("words")).alias("word")).select("class", spelt.alias("second"))
    pairs = often.join(every, "class").filter("first <> second")
    together = pairs.select("class", F.xxhash64(F.least("first", "second"), F.greatest("first", "second")).alias("block"), F.lit(None).cast("bigint").alias("likely_no"))
    return alone.unionByName(together).groupBy("class", "block").agg(F.max("likely_no").alias("likely_no"))


def _padded(column: pa.ChunkedArray, missing: float) -> tuple[np.ndarray, np.ndarray]:
    """Lists as the rows of a matrix, padded with a value, and the length of each."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    n = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    flat = lists.flatten().to_numpy()
    out = np.full((len(n), max(1, int(n.max(initial=0)))), missing, flat.dtype)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out, n


def _conflict(a: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray, same) -> np.ndarray:
    """Whether both of each pair state something and nothing of it is the same."""
    both = np.flatnonzero((n[p] > 0) & (n[q] > 0))
    out = np.zeros(len(p), bool)
    x, y = p[both], q[both]
    met = np.zeros(len(both), bool)
    for i in range(a.shape[1]):
        for j in range(a.shape[1]):
            met |= same(a[x, i], a[y, j]) & (n[x] > i) & (n[y] > j)
    out[both] = ~met
    return out


def _partners(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, sorted by block pair and side, the first row and the number of rows that it is compared with."""
    block, i, j, own = (t.column(c).to_numpy() for c in ("block", "i", "j", "own"))
    head = np.flatnonzero(np.r_[True, (np.diff(block) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)])
    group = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(block)]))
    stop = np.r_[head[1:], len(block)][group]
    across = i != j
    second = across & (own == j)
    n_second = np.bincount(group, weights=second, minlength=len(head)).astype(np.int64)[group]
    first = np.where(across, stop - n_second, np.arange(len(block)) + 1)
    return first, np.where(second, 0, stop - first)


def confirmed_pairs(t: pa.Table, idf: np.ndarray, least_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Classes (x, y), x < y, of the table's block pairs that nothing vetoes and whose names are similar. All pairs are looked at, as arrays."""
    first, n = _partners(t)
    label = t.column("class").to_numpy()
    fill = lambda c: t.column(c).fill_null(0).to_numpy()
    brand = np.where(fill("brand_no") != 0, fill("brand_no"), fill("likely_no"))
    kind = fill("kind_no")
    stated = [_padded(t.column(c), 0) for c in _STATED]
    near = -np.log(1 - SLACK) + 1e-12
    measured = []
    for c in MEASURES:
        a, m = _padded(t.column(c), 1.0)
        if m.any():
            measured.append((np.log(np.maximum(a, 1e-9)), m))
    grams, n_grams = _padded(t.column("grams"), -1)
    weight = np.where(grams >= 0, idf[np.maximum(grams, 0)].astype(np.float64) ** 2, 0.0)
    norm = np.sqrt(weight.sum(axis=1))
    keys = np.sort((np.arange(len(grams))[:, None] * GRAM_BUCKETS + grams)[grams >= 0])
    xs, ys = [], []
    ends = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        m = n[lo:hi]
        p = np.repeat(np.arange(lo, hi), m)
        q = np.arange(len(p)) - np.repeat(np.cumsum(m) - m, m) + first[p]
        lo = hi
        for code in (brand, kind):
            ok = (code[p] == code[q]) | (code[p] == 0) | (code[q] == 0)
            p, q = p[ok], q[ok]
        ok = label[p] != label[q]
        p, q = p[ok], q[ok]
        for a, m in stated:
            ok = ~_conflict(a, m, p, q, np.equal)
            p, q = p[ok], q[ok]
        for a, m in measured:
            ok = ~_conflict(a, m, p, q, lambda u, v: np.abs(u - v) <= near)
            p, q = p[ok], q[ok]
        for at in range(0, len(p), 1 << 15):
            u, v = p[at : at + (1 << 15)], q[at : at + (1 << 15)]
            want = v[:, None] * GRAM_BUCKETS + grams[u]
            there = keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want if len(keys) else np.zeros(want.shape, bool)
            both = (weight[u] * (there & (grams[u] >= 0))).sum(axis=1)
            good = both >= least_cosine * norm[u] * norm[v]
            a, b = label[u[good]], label[v[good]]
            xs.append(np.minimum(a, b))
            ys.append(np.maximum(a, b))
    none = np.zeros(0, np.int64)
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (none, none)


def product_pairs(items: DataFrame, least_cosine: float = LEAST_COSINE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(x, y) of classes of one product, (parent_asin, class), and the classes."""
    spark = items.sparkSession
    made, listed = classes(items)
    keyed = materialize(blocked(made))
    # inverse frequencies of n-grams over all classes: a table of bounded size
    n_classes = max(1, made.count())
    idf = np.full(GRAM_BUCKETS, np.log(1 + n_classes), np.float32)
    for r in made.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect():
        idf[r.gram] = np.log(1 + n_classes / r.n)
    weights = spark.sparkContext.broadcast(idf)

    sizes = keyed.groupBy("block").agg(F.count("*").alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    compared = ["brand_no", "kind_no", "grams", *_STATED, *MEASURES]
    placed = (
        keyed.join(sizes.select("block", "parts"), "block")
        .withColumn("own", F.pmod(F.xxhash64("class"), "parts").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("block", "class", "likely_no", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
        .join(made.select("class", *compared), "class")
        .repartition("block", "i", "j")
        .sortWithinPartitions("block", "i", "j", "own")
    )

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(t: pa.Table) -> pa.RecordBatch:
            x, y = confirmed_pairs(t, weights.value, least_cosine)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])

        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if not len(t):
                continue
            block, i, j = (t.column(c).to_numpy() for c in ("block", "i", "j"))
            last = np.flatnonzero((block != block[-1]) | (i != i[-1]) | (j != j[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last block pair may go on in the next batch
            if cut:
                yield out(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and len(held):
            yield out(held)

    pairs = materialize(placed.mapInArrow(confirm, "x bigint, y bigint").distinct())
    release(keyed)
    return pairs, listed, made


#: Values of one group that are paired in one task.
PAIRED = 4096


def pairs_within(groups: DataFrame, key: str, value: str) -> DataFrame:
    """(p, q) with p < q: all pairs of different values of each group; a large group is divided among tasks, block pair by block pair."""
    g = groups.select(F.col(key).alias("g"), F.col(value).alias("p")).distinct()
    sizes = g.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / PAIRED).cast("int"))
    placed = (
        g.join(sizes.select("g", "parts"), "g")
        .withColumn("own", F.pmod(F.xxhash64("p"), "parts").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("g", "p", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    return placed.alias("a").join(placed.alias("b"), ["g", "i", "j"]).filter("a.p < b.p AND (i = j OR a.own <> b.own)").select("a.p", F.col("b.p").alias("q"))


def same_product(items: DataFrame, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """(asin_a, asin_b) with asin_a < asin_b: different keys whose listings describe one product.

    Keys are compared byte by byte. Listings describe one product if they share a line's
    name, agree in brand and kind, in size, colour, number of pieces and model wherever both
    state it in title or features, and their names are similar. Keys that differ only in case
    or outer white space are a pair of their own. Null and empty keys, and listings without a
    title, match nothing by their text; repeated listings count once. An empty table gives no rows.
    """
    confirmed, listed, _ = product_pairs(items, least_cosine)
    left = listed.select(F.col("parent_asin").alias("p"), F.col("class").alias("x"))
    right = listed.select(F.col("parent_asin").alias("q"), F.col("class").alias("y"))
    across = confirmed.join(left, "x").join(right, "y").select("p", "q")
    keys = items.select(F.col("parent_asin").cast("string").alias("p")).filter("p <> ''").distinct()
    shape = F.upper(F.regexp_replace("p", r"(?U)^[\s​﻿]+|[\s​﻿]+$", ""))
    spelt = pairs_within(keys.withColumn("k", shape), "k", "p")
    every = across.unionByName(pairs_within(listed, "class", "parent_asin")).unionByName(spelt).filter("p <> q")
    return every.select(F.least("p", "q").alias("asin_a"), F.greatest("p", "q").alias("asin_b")).distinct()


def product_groups(items: DataFrame) -> DataFrame:
    """(parent_asin, product): keys grouped by confirmed pairs, directly or through others; product is the smallest key."""
    confirmed, listed, _ = product_pairs(items)
    labels = connected_components(confirmed.select(F.col("x").alias("a"), F.col("y").alias("b")))
    of = listed.join(labels, listed["class"] == labels.node, "left").select("parent_asin", F.coalesce("label", "class").alias("label"))
    # a key with listings in several classes joins their groups
    ties = connected_components(of.select(F.col("parent_asin").alias("a"), F.concat(F.lit("￿"), F.col("label").cast("string")).alias("b")))
    return ties.filter(~F.col("node").startswith("￿")).select(F.col("node").alias("parent_asin"), F.col("label").alias("product"))
