"""Records of evaluation splits that occur again in training, exactly or almost.

Records are made canonical and hashed; hashes of evaluation rows meet equal hashes of
training rows in a join. A title gives one hash of all its words and one for each word
left out, so that titles that differ in a single word meet too; that word must be a
misspelling, not another number, unit or colour. Titles of one or two words, which too many
would share with a word left out, give a hash for each letter left out instead, and so do
titles of a template, whose hashes with a word left out many rows share. Titles in which
two words have neighbouring letters swapped meet by the sorted letters of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.titles import canonical_words, protected
from sparkloom.shared import materialize

#: Letters from which on a word may be taken for a misspelling of another.
LEAST_LETTERS = 4
#: Words up to which a title is hashed with letters, not words, left out.
SHORT_TITLE = 2
#: Pairs of rows that a hash with a word left out may join; those of more are joined by that word's letters too.
MOST_PAIRS = 4096


def signatures(rows: DataFrame, id_col: str, title_col: str, key_col: str, split_col: str, train: str) -> DataFrame:
    """(id, train, hash, word): hashes of each row; word is the left-out word, null for whole records."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])

            def add(i: int, t: bool, text: str, word: str | None, out=out) -> None:
                for column, x in zip(out, (i, t, xxh3_128_digest(text.encode("utf-8", "surrogatepass")), word)):
                    column.append(x)

            for i, title, key, split in zip(*(c.to_pylist() for c in b.columns)):
                t = split == train
                key = (key or "").strip().casefold()
                if key:
                    add(i, t, "k\x1f" + key, None)
                words = canonical_words(title)
                if words:
                    add(i, t, "t\x1f" + "".join(words), None)
                spellable = [w for w in words if len(w) >= LEAST_LETTERS and w.isalpha() and not protected(w)]
                if len(spellable) > 1:
                    add(i, t, "a\x1f" + "\x1f".join("".join(sorted(w)) if w in spellable else w for w in words), "\x1f" + "\x1f".join(words))
                for k, w in enumerate(words):
                    if len(w) >= LEAST_LETTERS and w.isalpha() and not protected(w):
                        short = len(words) <= SHORT_TITLE
                        for part in {w, *(w[:j] + w[j + 1 :] for j in range(len(w)))} if short else ("",):
                            add(i, t, (f"s{k}\x1f" if short else "w\x1f") + "\x1f".join([*words[:k], part, *words[k + 1 :]]), w)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.string())], ["id", "train", "hash", "word"])

    slim = rows.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(title_col).alias("title"), F.col(key_col).alias("key"), F.col(split_col).alias("split")
    ).filter("split IS NOT NULL AND id IS NOT NULL")
    return slim.mapInArrow(work, "id bigint, train boolean, hash binary, word string")


def cross_split_pairs(
    rows: DataFrame, id_col: str = "item_id", title_col: str = "title", key_col: str = "parent_asin", split_col: str = "split", train: str = "train"
) -> DataFrame:
    """(eval_id, train_id): each row of another split with each training row that repeats it.

    Rows repeat each other if their keys are equal apart from case and outer white space, or
    their titles apart from case, accents, white space, punctuation, markup, repeated words,
    sales phrases, one word that is one letter dropped, added, changed or swapped with its
    neighbour, or two words with neighbouring letters swapped; words of fewer than LEAST_LETTERS letters are never taken for misspelt, as one
    letter makes them another word. Null and empty titles and keys, and titles of sales phrases only, match nothing;
    rows without a split or id are left out. Repeated rows give repeated pairs once. An
    empty table gives no rows.
    """
    signed = materialize(signatures(rows, id_col, title_col, key_col, split_col, train))
    # hashes of templates: a key of the word without each letter, which near words share, joins the hash
    is_train = F.col("train").cast("bigint")
    left_out = signed.filter("word IS NOT NULL AND NOT startswith(word, '\x1f')")
    often = left_out.groupBy("hash").agg(F.sum(is_train).alias("n_train"), F.sum(1 - is_train).alias("n_eval")).filter(F.col("n_train") * F.col("n_eval") > MOST_PAIRS)
    often = materialize(often.select("hash", F.lit(True).alias("often")))
    if often.isEmpty():
        s = signed
    else:
        marked = signed.join(often, "hash", "left").withColumn("often", F.col("often").isNotNull() & F.col("word").isNotNull() & ~F.startswith("word", F.lit("\x1f")))
        without = F.array_distinct(F.concat(F.array("word"), F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.concat(F.substring("word", F.lit(1), k - 1), F.substring(F.col("word"), k + 1, F.length("word"))))))
        finer = marked.filter("often").select("id", "train", "word", "hash", F.explode(without).alias("part"))
        finer = finer.select("id", "train", F.unhex(F.md5(F.concat("hash", F.encode("part", "utf-8")))).alias("hash"), "word")
        s = marked.filter("NOT often").select("id", "train", "hash", "word").unionByName(finer)
    left = s.filter("NOT train").select("hash", F.col("id").alias("eval_id"), F.col("word").alias("x"))
    right = s.filter("train").select("hash", F.col("id").alias("train_id"), F.col("word").alias("y"))
    letters = lambda c: F.array_join(F.array_sort(F.split(F.col(c), "")), "")
    swapped = (F.levenshtein("x", "y") == 2) & (F.length("x") == F.length("y")) & (letters("x") == letters("y"))
    twice = F.startswith("x", F.lit("\x1f")) & (F.levenshtein("x", "y", 4) >= 0)
    same = F.col("x").isNull() | F.when(F.startswith("x", F.lit("\x1f")), twice).otherwise((F.levenshtein("x", "y") <= 1) | swapped)
    return left.join(right, "hash").filter(same).select("eval_id", "train_id").distinct()


def overlap_classes(rows: DataFrame, id_col: str = "item_id", title_col: str = "title", split_col: str = "split", train: str = "train") -> DataFrame:
    """(id, split, class, n_train): rows by canonical title, and how many training rows have it; rows without a title have none.

    Whole copies are m times n pairs; their class and its counts are as many rows as there are.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for b in batches:
            keys = ["".join(canonical_words(t)) for t in b.column("title").to_pylist()]
            numbers = [xxh3_64_intdigest(k.encode("utf-8", "surrogatepass")) - (1 << 63) if k else None for k in keys]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("split"), pa.array(numbers, pa.int64())], ["id", "split", "class"])

    slim = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(title_col).alias("title"), F.col(split_col).alias("split")).filter("split IS NOT NULL AND id IS NOT NULL")
    of = slim.mapInArrow(work, "id bigint, split string, class bigint").filter("class IS NOT NULL")
    counts = of.groupBy("class").agg(F.sum((F.col("split") == train).cast("bigint")).alias("n_train"))
    return of.join(counts, "class").select("id", "split", "class", "n_train")


def overlap_report(rows: DataFrame, pairs: DataFrame, id_col: str = "item_id", split_col: str = "split", source_col: str = "main_category") -> DataFrame:
    """(split, source, n_rows, n_pairs): rows of each evaluation split and source that occur in training, and their pairs."""
    of = rows.select(F.col(id_col).alias("eval_id"), F.col(split_col).alias("split"), F.col(source_col).alias("source")).dropDuplicates(["eval_id"])
    per_row = pairs.groupBy("eval_id").agg(F.count("*").alias("n"))
    return per_row.join(of, "eval_id").groupBy("split", "source").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_pairs"))
