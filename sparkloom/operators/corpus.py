"""Training rows from the catalogue and from user histories, and queries for evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import history as H
from sparkloom.operators.sid import code_columns


def metadata_rows(catalog_with_sid: DataFrame) -> DataFrame:
    """(item_id, seq_type, input_text, target_text) of items that have all their codes."""
    codes = code_columns(catalog_with_sid)
    return catalog_with_sid.dropna(subset=codes).select(
        "item_id", F.lit("metadata").alias("seq_type"), X.metadata_prompt(F.col("title"), F.col("sub_category"), F.col("description")).alias("input_text"),
        X.sid_target([F.col(c) for c in codes]).alias("target_text"),
    )


def events_with_sids(events: DataFrame, item2feat: DataFrame) -> DataFrame:
    """Events of items with codes; sid holds them as an array."""
    codes = code_columns(item2feat)
    return events.join(item2feat.dropna(subset=codes).select("item_id", F.array(*codes).alias("sid")), "item_id")


def behaviour_rows(events: DataFrame, item2feat: DataFrame, cap: int = 50) -> DataFrame:
    """(user_id, seq_type, input_text, target_text): each user's last cap codes, the last as the target."""
    chained = H.split_last(H.chains(events_with_sids(events, item2feat), "sid", cap, min_length=2))
    return chained.select(
        "user_id", F.lit("behavior").alias("seq_type"), X.chain_text(F.col("history")).alias("input_text"),
        F.concat(F.substring(X.chain_text(F.array("target")), len(X.SEQ) + 2, 1 << 20), F.lit(X.SID_EOS)).alias("target_text"),
    )


def text_queries(events: DataFrame, titles: DataFrame, min_history: int = 2) -> DataFrame:
    """(user_id, query_text, target): the title of the last but one item asks for the last; empty titles ask nothing."""
    at = H.positions(H.with_min_history(events, min_history))
    ends = at.filter("from_end <= 2").groupBy("user_id").agg(
        F.max(F.when(F.col("from_end") == 1, F.col("item_id"))).alias("target"), F.max(F.when(F.col("from_end") == 2, F.col("item_id"))).alias("item_id")
    )
    titled = ends.join(titles.select("item_id", "title"), "item_id", "left")
    return titled.select("user_id", F.coalesce("title", F.lit("")).alias("query_text"), "target").filter("query_text <> ''")


def sequence_queries(events: DataFrame, item2feat: DataFrame, min_history: int = 2, max_history: int = 50) -> DataFrame:
    """(user_id, query_text, target): the codes of the last items ask for the last item.

    Only events of items with codes count, for the least history too; a history that is
    shorter than the least one after clipping asks nothing.
    """
    known = events_with_sids(events, item2feat)
    enough = H.with_min_history(known, min_history)
    paired = enough.withColumn("pair", F.struct("item_id", "sid"))
    chained = H.split_last(H.chains(paired, "pair", max_history + 1, min_length=2))
    clipped = chained.filter(F.size("history") >= min_history)
    return clipped.select("user_id", X.chain_text(F.transform("history", lambda x: x["sid"])).alias("query_text"), F.col("target.item_id").alias("target"))


def search_queries(embeddings: DataFrame, item2feat: DataFrame) -> DataFrame:
    """(query_id, q, sid_0..): an item's own vector asks for its own codes; null vectors ask nothing."""
    codes = code_columns(item2feat)
    return embeddings.filter("embedding IS NOT NULL").join(item2feat.dropna(subset=codes), "item_id").select(F.col("item_id").alias("query_id"), F.col("embedding").alias("q"), *codes)


def behaviour_only(corpus: DataFrame) -> DataFrame:
    """(input_text, target_text) of the corpus's behaviour rows; a corpus without kinds is all behaviour."""
    rows = corpus.filter(F.col("seq_type") == "behavior") if "seq_type" in corpus.columns else corpus
    return rows.select("input_text", "target_text")


def rows_at(corpus: DataFrame, ordinals: list[int], ordinal: str = "ordinal") -> DataFrame:
    """The rows of these ordinals, in a table sorted by them; the filter reaches the scan, so other row groups stay unread."""
    return corpus.filter(F.col(ordinal).isin(ordinals))


def trace_row(corpus: DataFrame, kind: str, order: list[str], max_input: int = 512, max_target: int = 16) -> DataFrame:
    """(step, value) of the first row of one kind, in the order given: its texts, its codes, and the lengths that training cuts.

    Input words and target tokens stand for a model's tokens.
    """
    one = corpus.filter(F.col("seq_type") == kind).orderBy(*order).limit(1)
    tokens = F.regexp_extract_all("target_text", F.lit("<[a-z0-9_]+>"), F.lit(0))
    words = F.split("input_text", " ")
    text = lambda c: c.cast("string")
    steps = [
        ("input_text", F.col("input_text")), ("target_text", F.col("target_text")), ("codes", F.array_join(F.transform(X.parse_sids(F.col("target_text")), text), " ")),
        ("input_words", text(F.size(words))), ("kept_words", text(F.least(F.size(words), F.lit(max_input)))), ("target_tokens", text(F.size(tokens))),
        ("kept_tokens", text(F.least(F.size(tokens), F.lit(max_target)))), ("ends", text(F.element_at(tokens, -1) == X.SID_EOS)),
    ]
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("step"), c.alias("value")) for n, c in steps))).alias("s")).select("s.*")
