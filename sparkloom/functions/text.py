"""Text expressions, all evaluated in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The mode markers and the end token of training texts.
SEQ, SEARCH, SID_EOS, SID_PAD = "<seq>", "<search>", "<sid_eos>", "<sid_pad>"


def strip_tags(c: Column) -> Column:
    """Markup tags become spaces."""
    return F.regexp_replace(c, "<[^>]+>", " ")


def collapse_space(c: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def _first_words(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        seen: set[str] = set()
        return " ".join([w for w in text.split(" ") if not (w.lower() in seen or seen.add(w.lower()))])

    return texts.map(one)


def dedup_words(c: Column) -> Column:
    """Keeps the first of equal words, whatever their case, in their order.

    Built-in array functions would take quadratic time on long texts, so this one is an
    Arrow batch function; it is linear in the text.
    """
    return _first_words(c)


def truncate(c: Column, n: int) -> Column:
    """At most n code points; white space at a new end goes."""
    return F.when(F.length(c) > n, F.regexp_replace(F.substring(c, 1, n), r"(?U)\s+$", "")).otherwise(c)


def clean_text(c: Column, max_chars: int = 500) -> Column:
    """Tags stripped, white space collapsed, repeated words dropped, truncated; null gives ''."""
    return truncate(dedup_words(collapse_space(strip_tags(F.coalesce(c, F.lit(""))))), max_chars)


def sid_text(codes: list[Column]) -> Column:
    """<sid_a><sid_b>.. of the codes."""
    return F.concat(*(F.concat(F.lit("<sid_"), c.cast("string"), F.lit(">")) for c in codes))


def sid_target(codes: list[Column]) -> Column:
    return F.concat(sid_text(codes), F.lit(SID_EOS))


def chain_text(chain: Column) -> Column:
    """Mode marker and the codes of a chain of code arrays, without spaces between them."""
    one = lambda sid: F.array_join(F.transform(sid, lambda x: F.concat(F.lit("<sid_"), x.cast("string"), F.lit(">"))), "")
    return F.concat(F.lit(SEQ + " "), F.array_join(F.transform(chain, one), ""))


def metadata_prompt(title: Column, category: Column, description: Column, max_chars: int = 500) -> Column:
    """`<seq> title: T | category: C | description: D`; empty parts, and an unknown category, are left out."""
    part = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}: "), c))
    t, d = clean_text(title, max_chars), clean_text(description, max_chars)
    known = F.when(F.lower(F.coalesce(category, F.lit(""))) != "unknown", F.coalesce(category, F.lit("")))
    return F.concat(F.lit(SEQ + " "), F.concat_ws(" | ", F.concat(F.lit("title: "), t), part("category", known), part("description", d)))


def parse_sids(c: Column, depth: int = 4) -> Column:
    """The first depth codes of a text, null if it has fewer."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"<sid_(\d+)>"), F.lit(1)), lambda x: x.cast("bigint"))
    return F.when(F.size(found) >= depth, F.slice(found, 1, depth))


def pad_sids(codes: Column, depth: int = 4) -> Column:
    """At most depth codes, padded with -1."""
    cut = F.slice(codes, 1, depth)
    return F.concat(cut, F.array_repeat(F.lit(-1).cast("bigint"), F.lit(depth) - F.size(cut)))


def shard_path(folder: str, item_id: Column) -> Column:
    """folder/shard/id.jpg; the shard is the id, or its thousands from 1000 on, with three digits at least."""
    shard = F.when(item_id < 1000, item_id).otherwise(F.floor(item_id / 1000))
    return F.concat(F.lit(f"{folder}/"), F.format_string("%03d", shard.cast("bigint")), F.lit("/"), item_id.cast("string"), F.lit(".jpg"))


def end_with_period(c: Column) -> Column:
    return F.when(F.endswith(c, F.lit(".")), c).otherwise(F.concat(c, F.lit(".")))


def first_match(array: Column, predicate) -> Column:
    """The first element that satisfies the predicate, or null."""
    return F.get(F.filter(array, predicate), F.lit(0))


def element_or(array: Column, index: int, default) -> Column:
    """The element at a 0-based index, or the default."""
    return F.coalesce(F.get(array, F.lit(index)), F.lit(default))


def mask_labels(ids: Column, pad: int, max_len: int) -> Column:
    """Labels of at most max_len, padding replaced by -100."""
    return F.transform(F.slice(ids, 1, max_len), lambda x: F.when(x == pad, F.lit(-100)).otherwise(x))


def pad_to(ids: Column, pad: int, length: int) -> Column:
    """Ids cut or padded to a length."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad).cast("int"), F.lit(length) - F.size(cut)))
