"""Encoding of a corpus with a public byte-pair vocabulary, through a lexicon automaton.

Texts are cut where a line feed follows a character that is no white space, which is
always a border between pre-tokens; equal pieces are encoded once in a worker. The
distinct words of a batch of texts are looked up in a lexicon, all at once: the corpus's
frequent words, compiled into a minimal acyclic automaton (states with equal continuations
are shared) whose paths carry word counts, so that a word's path sums to its number and the
number gives its ids. The automaton is a file in the shared folder that workers map into
memory. Words that it lacks are merged exactly by the vocabulary's ranks.
"""

from __future__ import annotations

import base64
import os
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.shared import materialize, release, shared_dir

#: Where the public vocabulary files are.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: the pattern of the byte_bpe_50k pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words in the lexicon at most; it bounds the driver's work and the mapped file.
LEXICON_WORDS = 1 << 14
#: Characters of pieces that a worker remembers, and words it remembers.
CACHE_CHARS, CACHE_WORDS = 1 << 21, 1 << 17
#: Characters of the texts that are encoded together.
BATCH_CHARS = 1 << 20


def load_ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
    """The vocabulary as an exact merger of single words."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def merge_word(encoding, word: str) -> list[int]:
    """The ids of one pre-token by rank-ordered merges; alone, it is one pre-token too."""
    return encoding.encode_ordinary(word)


class Lexicon:
    """A minimal acyclic automaton over the UTF-8 bytes of words, with ids as outputs.

    first[s]..first[s + 1] are the transitions of state s: label, target, and before,
    the number of words that sort ahead of this transition within the state. Sums of
    before (and of a final state passed on the way) number the words in sorted order;
    id_at and ids hold the outputs by that number.
    """

    FIELDS = ("first", "label", "target", "before", "final", "id_at", "ids")

    def __init__(self, **arrays: np.ndarray) -> None:
        self.arrays = arrays
        first = arrays["first"].astype(np.int64)
        self.keys = np.repeat(np.arange(len(first) - 1), np.diff(first)) * 256 + arrays["label"]  # state and byte of each transition, in order

    @classmethod
    def build(cls, words: dict[str, list[int]]) -> Lexicon:
        """Compiles the words incrementally in sorted order, merging equal states as they close."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []
        counts: list[int] = []

        def close(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
                counts.append(node[0] + sum(counts[t] for _, t in node[1]))
            return register[key]

        order = sorted(words, key=lambda w: w.encode())
        path: list[list] = [[0, []]]  # open states along the last word: [final, closed transitions]
        last = b""
        for w in order:
            b = w.encode()
            k = 0
            while k < min(len(b), len(last)) and b[k] == last[k]:
                k += 1
            while len(path) > k + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], close(node)))
            path += [[0, []] for _ in b[k:]]
            path[-1][0] = 1
            last = b
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], close(node)))
        root = close(path[0])
        perm = [root, *(i for i in range(len(states)) if i != root)]
        number = {old: new for new, old in enumerate(perm)}
        first, label, target, before, final = [0], [], [], [], []
        for old in perm:
            fin, out = states[old]
            final.append(fin)
            ahead = fin
            for c, t in out:
                label.append(c)
                target.append(number[t])
                before.append(ahead)
                ahead += counts[t]
            first.append(len(label))
        ids = [words[w] for w in order]
        return cls(
            first=np.array(first, np.int32), label=np.array(label, np.uint8), target=np.array(target, np.int32),
            before=np.array(before, np.int32), final=np.array(final, np.uint8),
            id_at=np.cumsum([0, *map(len, ids)], dtype=np.int64), ids=np.array([i for x in ids for i in x], np.int32),
        )

    def write(self, folder: str) -> None:
        os.makedirs(folder)
        for k in self.FIELDS:
            np.save(f"{folder}/{k}.npy", self.arrays[k])

    @classmethod
    def open(cls, folder: str) -> Lexicon:
        return cls(**{k: np.load(f"{folder}/{k}.npy", mmap_mode="r").view(np.ndarray) for k in cls.FIELDS})

    def find_all(self, words: list[bytes]) -> list[bytes | None]:
        """Each word's ids as int32 bytes, or None where the lexicon lacks it: all paths are walked together, a byte at a time."""
        a = self.arrays
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start = np.cumsum(size) - size
        state, number = np.zeros(n, np.int64), np.zeros(n, np.int64)
        left = np.flatnonzero(size > 0)
        state[size == 0] = -1
        k = 0
        while len(left) and len(self.keys):
            want = state[left] * 256 + flat[start[left] + k]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            there = self.keys[at] == want
            state[left[~there]] = -1
            left, at = left[there], at[there]
            number[left] += a["before"][at]
            state[left] = a["target"][at]
            k += 1
            left = left[size[left] > k]
        if not len(self.keys):
            state[:] = -1
        ok = state >= 0
        ok[ok] = a["final"][state[ok]] > 0
        lo, hi = a["id_at"][number * ok], a["id_at"][(number + 1) * ok]
        ids = a["ids"]
        return [ids[i:j].tobytes() if good else None for good, i, j in zip(ok.tolist(), lo.tolist(), hi.tolist())]


_WIDE_SPACE = re.compile(r"\s |^ ").search


def pieces(text: str) -> list[str]:
    """Cuts before each line feed that follows a character that is no white space."""
    parts = text.split("\n")
    out = [parts[0]]
    for p in parts[1:]:
        if out[-1] and not out[-1][-1].isspace():
            out.append("\n" + p)
        else:
            out[-1] += "\n" + p
    return out


def spaced(piece: str) -> list[str]:
    """Cuts before each space that follows a character that is no white space, and drops those spaces.

    Such a space always begins a pre-token, so every part but the first is encoded as
    if a space stood before it.
    """
    parts = piece.split(" ")
    if not _WIDE_SPACE(piece):
        return parts
    out = [parts[0]]
    for p in parts[1:]:
        if out[-1] and not out[-1][-1].isspace():
            out.append(p)
        else:
            out[-1] += " " + p
    return out


class Encoder:
    """A worker's encoder: pieces, then words, then the lexicon, then exact merges."""

    def __init__(self, lexicon: Lexicon, name: str, folder: str) -> None:
        import regex

        self.lexicon = lexicon
        self.split = regex.compile(PATTERN).findall
        self.merger = load_ranks(name, folder)
        self.seen: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}  # parts behind a space
        self.done: dict[str, bytes] = {}
        self.held = 0

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as int32 bytes."""
        cut = [pieces(t) for t in texts]
        if self.held > CACHE_CHARS:
            self.done, self.held = {}, 0
        self._learn({p for own in cut for p in own if p not in self.done})
        done = self.done
        return [b"".join([done[p] for p in own]) for own in cut]

    def _learn(self, new: set[str]) -> None:
        """Encodes pieces that aren't known; what is remembered is dropped first where it grows too large."""
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        if len(self.seen) > CACHE_WORDS:
            self.seen = {}
        split, seen, words = self.split, self.seen, self.words
        heads = {p: spaced(p) for p in new}
        parts = {w: split(" " + w) for own in heads.values() for w in own[1:] if w not in words}
        first = {own[0]: split(own[0]) for own in heads.values()}
        unknown = list({w for own in (*parts.values(), *first.values()) for w in own if w not in seen})
        for w, ids in zip(unknown, self.lexicon.find_all([w.encode() for w in unknown])):
            seen[w] = ids if ids is not None else np.array(merge_word(self.merger, w), np.int32).tobytes()
        for w, own in parts.items():
            words[w] = b"".join([seen[x] for x in own])
        for p, own in heads.items():
            self.done[p] = b"".join([*[seen[x] for x in first[own[0]]], *[words[w] for w in own[1:]]])
            self.held += len(p)


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): pre-tokens of all texts with their counts, reduced in each split before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(PATTERN).findall
        heads: Counter[str] = Counter()
        rest: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for parts, before in ((heads, ""), (rest, " ")):
                for p, n in parts.items():
                    for w in split(before + p):
                        words[w] += n
                parts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"]
            )

        chars = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for p in pieces(text):
                    head, *more = spaced(p)
                    heads[head] += 1
                    rest.update(more)
                chars += len(text)
                if len(heads) + len(rest) > CACHE_WORDS or chars > 4 * CACHE_CHARS:
                    yield flush()
                    chars = 0
        if heads or rest:
            yield flush()

    slim = docs.select(F.col(text_col).alias("text")).filter("text <> ''")
    return slim.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, text_col: str, words: int) -> list[str]:
    """The corpus's most frequent words that occur more than once, at most so many.

    Counts are over all texts. A histogram of the counts, in classes of a twentieth of a
    power of two, tells from which class on all words fit the bound; only those words come
    to the driver. Words of a class stay together, so there are no ties to break.
    """
    counts = materialize(count_words(docs, text_col).filter("n > 1").withColumn("class", F.floor(F.log2("n") * 20).cast("int")))
    room, least = words, None
    for r in counts.groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("class")).collect():  # at most 20 * 63 classes
        room -= r.n
        if room < 0:
            break
        least = r["class"]
    top = [r.word for r in counts.filter(F.col("class") >= least).select("word").collect()] if least is not None else []
    release(counts)
    return top


def fit_lexicon(docs: DataFrame, text_col: str, name: str, folder: str, words: int) -> Callable[[], Lexicon]:
    """Compiles the corpus's most frequent words and returns how a worker opens them."""
    spark: SparkSession = docs.sparkSession
    merger = load_ranks(name, folder)
    lexicon = Lexicon.build({w: merge_word(merger, w) for w in frequent_words(docs, text_col, words)})
    out = urlparse(f"{shared_dir(spark)}/lexicon-{uuid.uuid4().hex}")
    if out.scheme not in ("", "file"):  # no path that can be mapped: the bounded arrays travel themselves
        shared = spark.sparkContext.broadcast(lexicon.arrays)
        return lambda: Lexicon(**shared.value)
    lexicon.write(out.path)
    return lambda: Lexicon.open(out.path)


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k",
    folder: str = TOKENIZER_DIR, lexicon_words: int = LEXICON_WORDS, lengths_only: bool = False,
) -> DataFrame:
    """(doc_id, ids): the token ids of every text without special tokens, or (doc_id, n_tokens).

    Strings of special tokens within a text are ordinary text. Null and empty texts give
    an empty list (0 tokens). Repeated rows give repeated rows. Other columns are ignored.
    """
    opened = fit_lexicon(docs, text_col, name, folder, lexicon_words)
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(opened(), name, folder)
        for batch in batches:
            n = batch.num_rows
            at = 0
            while at < n:  # as many texts at a time as have a bounded length, whatever each has
                texts, first, chars = [], at, 0
                while at < n and chars < BATCH_CHARS:
                    texts.append(batch.column(1)[at].as_py() or "")
                    chars += len(texts[-1])
                    at += 1
                outs = encoder.texts(texts)
                sizes = [len(x) // 4 for x in outs]
                ids = batch.column(0).slice(first, at - first)
                if lengths_only:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])
                else:
                    offsets = pa.array(np.cumsum([0, *sizes], dtype=np.int32))
                    flat = pa.array(np.frombuffer(b"".join(outs), np.int32))
                    yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "ids"])

    return slim.mapInArrow(work, "doc_id bigint, n_tokens bigint" if lengths_only else "doc_id bigint, ids array<int>")
