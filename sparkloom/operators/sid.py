"""Semantic ids: lookup, collisions, use of codes, and the prefix tree as level tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def code_columns(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c.startswith("sid_")), key=lambda c: int(c[4:]))


def join_sids(catalog: DataFrame, item2feat: DataFrame, ordinal: str | None = None) -> DataFrame:
    """The catalogue with its codes, null without; of repeated ids in item2feat the last one counts."""
    from sparkloom.operators.catalog import last_wins

    codes = code_columns(item2feat)
    one = last_wins(item2feat, ["item_id"], [ordinal] if ordinal else codes).select("item_id", *codes)
    return catalog.join(one, "item_id", "left")


def sid_to_item(item2feat: DataFrame) -> DataFrame:
    """(sid_0.., item_id): the smallest item of each id."""
    return item2feat.groupBy(*code_columns(item2feat)).agg(F.min("item_id").alias("item_id"))


def collisions(item2feat: DataFrame) -> DataFrame:
    """(sid_0.., n_items, item_ids): ids of several items, with all of them in order; largest first is the caller's sort."""
    grouped = item2feat.groupBy(*code_columns(item2feat)).agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    return grouped.filter("n_items >= 2")


def collision_stats(item2feat: DataFrame) -> DataFrame:
    """(n_total, n_unique, n_groups, n_lost, share_lost) in one pass over the groups."""
    groups = item2feat.groupBy(*code_columns(item2feat)).agg(F.count("*").alias("n"))
    sums = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"), F.count("*").alias("n_unique"), F.coalesce(F.sum((F.col("n") >= 2).cast("bigint")), F.lit(0)).alias("n_groups"))
    lost = F.col("n_total") - F.col("n_unique")
    return sums.withColumn("n_lost", lost).withColumn("share_lost", F.coalesce(F.try_divide(lost, F.col("n_total")), F.lit(0.0)))


def codebook_usage(item2feat: DataFrame, codes: int) -> DataFrame:
    """(level, n_used, share_used) of each level's codes."""
    names = code_columns(item2feat)
    pairs = F.array(*(F.struct(F.lit(k).alias("level"), F.col(n).alias("code")) for k, n in enumerate(names)))
    used = item2feat.select(F.explode(pairs).alias("p")).select("p.level", "p.code").filter("code IS NOT NULL").distinct()
    return used.groupBy("level").agg(F.count("*").alias("n_used"), (F.count("*") / F.lit(float(codes))).alias("share_used"))


def trie_levels(item2feat: DataFrame) -> list[DataFrame]:
    """One table of distinct prefixes for each length."""
    names = code_columns(item2feat)
    return [item2feat.select(*names[: k + 1]).dropna().distinct() for k in range(len(names))]


def store_index(item2feat: DataFrame, folder: str) -> None:
    """Writes the prefix tables and the lookup as Parquet tables of one folder."""
    for k, level in enumerate(trie_levels(item2feat)):
        level.write.mode("overwrite").parquet(f"{folder}/prefixes_{k + 1}")
    sid_to_item(item2feat).write.mode("overwrite").parquet(f"{folder}/lookup")


def load_index(spark, folder: str) -> tuple[list[DataFrame], DataFrame]:
    """The prefix tables and the lookup of a folder; the lookup's codes tell the number of levels."""
    lookup = spark.read.parquet(f"{folder}/lookup")
    return [spark.read.parquet(f"{folder}/prefixes_{k + 1}") for k in range(len(code_columns(lookup)))], lookup


def children(trie: list[DataFrame], prefixes: DataFrame) -> DataFrame:
    """Prefixes (sid_0.. of one length) with each code that may follow; unknown prefixes give none."""
    names = code_columns(prefixes)
    level = trie[len(names)]
    return prefixes.join(level, names) if names else prefixes.crossJoin(F.broadcast(level))  # codes of one level


def is_valid(trie: list[DataFrame], sids: DataFrame) -> DataFrame:
    """Adds valid: the row's codes are a full path."""
    names = code_columns(trie[-1])
    return sids.join(trie[-1].withColumn("valid", F.lit(True)), names, "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def allowed_mask(codes: Column, size: int) -> Column:
    """A mask over all codes from the list of allowed ones; codes beyond the size are ignored."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(codes, i.cast("bigint")))


def mask_logits(logits: Column, codes: Column, blocked: float = -1e9) -> Column:
    """Logits with every code that is not allowed set to a large negative number."""
    return F.transform(logits, lambda x, i: F.when(F.array_contains(codes, i.cast("bigint")), x).otherwise(F.lit(blocked)))


def vocabulary(spark, codes: int = 1024, first_id: int = 0) -> DataFrame:
    """(token, token_id, code): the added tokens in order; the four special ones have no code."""
    from sparkloom.functions.text import SEARCH, SEQ, SID_EOS, SID_PAD

    special = spark.createDataFrame([(t, codes + k) for k, t in enumerate((SID_PAD, SID_EOS, SEQ, SEARCH))], "token string, n bigint")
    plain = spark.range(codes).select(F.concat(F.lit("<sid_"), F.col("id").cast("string"), F.lit(">")).alias("token"), F.col("id").alias("n"))
    return plain.unionByName(special).select("token", (F.col("n") + first_id).alias("token_id"), F.when(F.col("n") < codes, F.col("n")).alias("code"))
