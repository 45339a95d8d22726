"""Beam search over semantic ids, constrained by the prefix tables: one join and one cut a level.

A code that no item has after a beam's prefix is blocked: its score is BLOCKED. Where there are
fewer beams than asked for without them, blocked ones fill the width and end as misses behind
all hits; a prefix that no item has allows every code, and so does every slot behind the last.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.vectors import doubles, squared_distance, subtract
from sparkloom.operators import sid as S
from sparkloom.shared import materialize

#: Fixed value: the log score of a blocked code.
BLOCKED = -1.0e9
#: (beams with sid_0 .. sid_{level}, level) -> the same rows with step, the log score of the last code.
Scorer = Callable[[DataFrame, int], DataFrame]


def quantiser_scorer(spark, codebooks: list[np.ndarray]) -> Scorer:
    """Scores a code by minus the squared distance of the query's residual to it, and moves the residual on.

    Beams carry the residual in column state. Codebooks are tables of some thousand rows at most.
    """
    tables = []
    for k, book in enumerate(codebooks):
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(book)]
        tables.append(F.broadcast(spark.createDataFrame(rows, f"sid_{k} bigint, centre array<double>")))

    def score(beams: DataFrame, level: int) -> DataFrame:
        near = beams.join(tables[level], f"sid_{level}")
        return near.withColumn("step", -squared_distance(F.col("state"), F.col("centre"))).withColumn("state", subtract(F.col("state"), F.col("centre"))).drop("centre")

    return score


def count_scorer(behaviour: DataFrame, codes: int, alpha: float = 1.0) -> Scorer:
    """Scores a code by its smoothed frequency after the prefix, given the last item of the history, backing off to the prefix alone.

    behaviour: (context, sid_0.., ) of observed next items; beams carry context in column state.
    """
    names = S.code_columns(behaviour)

    def score(beams: DataFrame, level: int) -> DataFrame:
        prefix = names[:level]
        seen = behaviour.groupBy("context", *prefix, names[level]).agg(F.count("*").alias("n_code"))
        whole = behaviour.groupBy("context", *prefix).agg(F.count("*").alias("n_prefix"))
        seen_all = behaviour.groupBy(*prefix, names[level]).agg(F.count("*").alias("m_code"))
        whole_all = behaviour.groupBy(*prefix).agg(F.count("*").alias("m_prefix")) if prefix else behaviour.agg(F.count("*").alias("m_prefix"))
        b = beams.withColumnRenamed("state", "context")
        b = b.join(seen, ["context", *prefix, names[level]], "left").join(whole, ["context", *prefix], "left").join(seen_all, [*prefix, names[level]], "left")
        b = b.join(whole_all, prefix, "left") if prefix else b.crossJoin(F.broadcast(whole_all))
        n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
        back = (n("m_code") + alpha / codes) / (n("m_prefix") + alpha)
        p = (n("n_code") + alpha * back) / (n("n_prefix") + alpha)
        return b.withColumn("step", F.log(p)).withColumnRenamed("context", "state").drop("n_code", "n_prefix", "m_code", "m_prefix")

    return score


def text_scorer(texts: DataFrame, codes: int, alpha: float = 1.0, beta: float = 0.01) -> Scorer:
    """Scores a code after a prefix by its smoothed frequency and that of the query's words in texts of items with it.

    texts: (words array<string>, sid_0..) of known items; beams carry the query's words in
    column state. Words that no text has, and queries without words, leave the frequencies of
    codes to decide.
    """
    names = S.code_columns(texts)
    each = texts.select(*names, F.explode("words").alias("word"))
    n_words = each.select("word").distinct().agg(F.count("*").alias("vocabulary"))

    def score(beams: DataFrame, level: int) -> DataFrame:
        prefix, path = names[:level], names[: level + 1]
        seen = texts.groupBy(*path).agg(F.count("*").alias("n_code"))
        whole = texts.groupBy(*prefix).agg(F.count("*").alias("n_prefix")) if prefix else texts.agg(F.count("*").alias("n_prefix"))
        lengths = each.groupBy(*path).agg(F.count("*").alias("n_all"))
        found = each.groupBy(*path, "word").agg(F.count("*").alias("n_word"))
        known = each.select("word").distinct()
        asked = beams.select("query_id", *path, F.explode("state").alias("word")).join(known, "word", "left_semi")
        fit = (
            asked.join(found, [*path, "word"], "left").join(lengths, path, "left").crossJoin(F.broadcast(n_words))
            .groupBy("query_id", *path)
            .agg(F.sum(F.log((F.coalesce("n_word", F.lit(0)) + beta) / (F.coalesce("n_all", F.lit(0)) + beta * F.col("vocabulary")))).alias("fit"))
        )
        b = beams.join(seen, path, "left")
        b = b.join(whole, prefix, "left") if prefix else b.crossJoin(F.broadcast(whole))
        prior = F.log((F.coalesce("n_code", F.lit(0)) + alpha / codes) / (F.coalesce("n_prefix", F.lit(0)) + alpha))
        b = b.join(fit, ["query_id", *path], "left")
        return b.withColumn("step", prior + F.coalesce("fit", F.lit(0.0))).drop("n_code", "n_prefix", "fit")

    return score


def mask_slots(prefixes: DataFrame, trie: list[DataFrame], codes: int, slot: int) -> DataFrame:
    """prefixes (sid_0 .. sid_{slot - 1}) with each code and whether it is blocked at this slot.

    Slots behind the last level block nothing, and neither does a prefix that no item has.
    """
    every = F.broadcast(prefixes.sparkSession.range(codes).withColumnRenamed("id", "code"))
    crossed = prefixes.crossJoin(every)
    if slot >= len(trie):
        return crossed.withColumn("blocked", F.lit(False))
    names = [f"sid_{i}" for i in range(slot)]
    allowed = trie[slot].withColumnRenamed(f"sid_{slot}", "code").withColumn("_ok", F.lit(True))
    marked = crossed.join(allowed, [*names, "code"], "left")
    if slot:
        marked = marked.join(trie[slot - 1].withColumn("_live", F.lit(True)), names, "left")
    else:
        marked = marked.withColumn("_live", F.lit(True))
    return marked.withColumn("blocked", F.col("_live").isNotNull() & F.col("_ok").isNull()).drop("_ok", "_live")


@dataclass(frozen=True)
class Retriever:
    """What a search needs: the prefix tables, the lookup, a scorer and the number of codes of a level."""

    trie: list[DataFrame]
    lookup: DataFrame
    scorer: Scorer
    codes: int

    @classmethod
    def of(cls, item2feat: DataFrame, scorer: Scorer, codes: int) -> Retriever:
        if not S.code_columns(item2feat):
            raise ValueError("item2feat has no sid columns")
        return cls(S.trie_levels(item2feat), S.sid_to_item(item2feat), scorer, codes)

    def search(self, queries: DataFrame, k: int = 10, beams: int | None = None, constrained: bool = True) -> DataFrame:
        """(query_id, rank, sid_0.., score, item_id): the k best ids of each query (query_id, state).

        All queries run together. Each level joins the codes that may follow, adds their
        score, and keeps the best of each query, cut before the shuffle. beams is max(k, 4)
        by default and k at least. An id without an item has item_id -1: unconstrained searches
        give such ids, and constrained ones only behind all hits, where the catalogue has fewer
        first codes than there are beams. Ties go to the smaller codes.
        """
        width = check_beams(beams or max(k, 4), [k])
        spark = queries.sparkSession
        names = [f"sid_{i}" for i in range(len(self.trie))]
        now = queries.select("query_id", "state", F.lit(0.0).alias("score"))
        every = F.broadcast(spark.range(self.codes).withColumnRenamed("id", "code"))
        # with a first code for each beam, every beam has a child at every level, and blocked codes never come to bear
        filled = constrained and self.trie[0].count() < width
        for level, name in enumerate(names):
            if not constrained:
                nxt = now.crossJoin(every.withColumnRenamed("code", name))
            elif filled:
                nxt = mask_slots(now, self.trie, self.codes, level).withColumnRenamed("code", name)
            else:
                nxt = now.join(self.trie[level], names[:level]) if level else now.crossJoin(F.broadcast(self.trie[0]))  # codes of one level
            scored = self.scorer(nxt, level)
            step = F.when(F.col("blocked"), F.lit(BLOCKED)).otherwise(F.col("step")) if filled else F.col("step")
            scored = scored.withColumn("score", F.col("score") + step).drop("step", "blocked")
            w = W.partitionBy("query_id").orderBy(F.desc("score"), *names[: level + 1])
            now = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= width)
            now = materialize(now) if level == 1 and len(names) > 2 else now
            now = now.drop("rank") if level < len(names) - 1 else now
        found = now.filter(F.col("rank") <= k).join(self.lookup, names, "left")
        return found.select("query_id", "rank", *names, "score", F.coalesce("item_id", F.lit(-1)).alias("item_id"))

    def evaluate(self, queries: DataFrame, targets: DataFrame, ks: list[int], beams: int = 4, constrained: bool = True) -> DataFrame:
        """(metric, value): recall and ndcg at every cut-off, from one search with as many beams as the largest needs."""
        from sparkloom.operators.metrics import recall_ndcg

        return recall_ndcg(self.search(queries, max(ks), check_beams(beams, ks), constrained), targets, ks)


def check_beams(beams: int, ks: list[int]) -> int:
    """The beams a search needs for its cut-offs."""
    return max(beams, *ks)


def start_from_vectors(queries: DataFrame, vec: str = "q") -> DataFrame:
    """(query_id, state) for the quantiser's scorer."""
    return queries.select("query_id", doubles(F.col(vec)).alias("state"))
