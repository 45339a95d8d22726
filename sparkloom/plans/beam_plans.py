"""Beam search over semantic ids, and what it generates against the catalogue.

The scorers stand in for a trained sequence model: residual distances for vectors, and
smoothed counts for histories. They answer the same kind of query with another model.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import beam as B
from sparkloom.operators import corpus as K
from sparkloom.operators import history as H
from sparkloom.operators import metrics as M
from sparkloom.operators import sid as S
from sparkloom.plans.common import CODES, EVENTS, S4, SID, codebooks, events, sids, vectors
from sparkloom.plans.text_plans import clean_sql

NAMES = ["sid_0", "sid_1", "sid_2", "sid_3"]


def _search(spark, folder, constrained: bool):
    retriever = B.Retriever.of(sids(spark, folder), B.quantiser_scorer(spark, codebooks(spark, folder)), CODES)
    queries = B.start_from_vectors(vectors(spark, folder).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("q")))
    return retriever.search(queries, k=5, beams=8, constrained=constrained)


def beam_search_quantizer(spark, folder):
    """The five best ids for every vector, constrained."""
    return _search(spark, folder, True).select("query_id", F.col("rank").cast("bigint").alias("rank"), *NAMES, "item_id")


def beam_unconstrained(spark, folder):
    """The same without the prefix tables; unknown ids have item -1."""
    return _search(spark, folder, False).select("query_id", F.col("rank").cast("bigint").alias("rank"), *NAMES, "item_id")


def hallucination_rate(spark, folder):
    """The share of unconstrained top ids that no item has."""
    top = _search(spark, folder, False).filter("rank = 1")
    return M.miss_rate(top, sids(spark, folder), NAMES).select("n_generated", "n_missing", F.round("rate", 6).alias("rate"))


WIDE = 64


def _of_one_label(spark, folder):
    """Every vector's WIDE beams over the ids of the items of label 0, which have fewer first codes."""
    known = sids(spark, folder).join(spark.read.parquet(f"{folder}/embeddings.parquet").filter("label = 0").select(F.col("vec_id").alias("item_id")), "item_id", "left_semi")
    retriever = B.Retriever.of(known, B.quantiser_scorer(spark, codebooks(spark, folder)), CODES)
    queries = B.start_from_vectors(vectors(spark, folder).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("q")))
    return retriever.search(queries, k=WIDE, beams=WIDE)


def silent_miss_rate(spark, folder):
    """The share of constrained ids that the lookup lacks, where there are more beams than first codes."""
    got = _of_one_label(spark, folder)
    return got.agg(F.count("*").alias("n_generated"), F.count_if(F.col("item_id") < 0).alias("n_missing")).select("n_generated", "n_missing", F.round(F.col("n_missing") / F.col("n_generated"), 6).alias("rate"))


def beam_fills(spark, folder):
    """The hits of that search, which stand before its misses."""
    return _of_one_label(spark, folder).filter("item_id >= 0").select("query_id", F.col("rank").cast("bigint").alias("rank"), *NAMES, "item_id")


def beam_mask_slots(spark, folder):
    """Codes allowed at every slot after known prefixes, after prefixes that no item has, and behind the last slot."""
    s = sids(spark, folder)
    trie = S.trie_levels(s)
    out = None
    for slot in range(5):
        names = NAMES[:slot]
        known = s.select(*names).distinct().withColumn("kind", F.lit("known"))
        if slot:
            moved = [F.col(n) for n in names[:-1]] + [((F.col(names[-1]) + 1) % CODES).alias(names[-1])]
            known = known.unionByName(known.select(*moved, F.lit("moved").alias("kind")))
        part = B.mask_slots(known, trie, CODES, slot).groupBy("kind", *names).agg(F.count_if(~F.col("blocked")).alias("n_allowed"))
        cols = [F.col(n) if n in names else F.lit(-1).cast("bigint").alias(n) for n in NAMES]
        part = part.select(F.lit(slot).cast("bigint").alias("slot"), "kind", *cols, "n_allowed")
        out = part if out is None else out.unionByName(part)
    return out


def beam_metrics(spark, folder):
    """Recall and ndcg of a search for every vector's own item, whose beams are raised to the largest cut-off."""
    own = sids(spark, folder).join(S.sid_to_item(sids(spark, folder)).withColumnRenamed("item_id", "target"), NAMES)
    retriever = B.Retriever.of(sids(spark, folder), B.quantiser_scorer(spark, codebooks(spark, folder)), CODES)
    queries = B.start_from_vectors(vectors(spark, folder).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("q")))
    got = retriever.evaluate(queries, own.select(F.col("item_id").alias("query_id"), "target"), [1, 5, 8])
    return got.select("metric", F.round("value", 6).alias("value"))


def beam_text(spark, folder):
    """The five best items for the name of every part that has an id, by the words of names; no SQL."""
    names = spark.read.parquet(f"{folder}/part.parquet").select(F.col("p_partkey").alias("item_id"), F.split(F.lower("p_name"), " ").alias("words"))
    known = names.join(sids(spark, folder), "item_id")
    retriever = B.Retriever.of(sids(spark, folder), B.text_scorer(known.select("words", *NAMES), CODES), CODES)
    queries = known.select(F.col("item_id").alias("query_id"), F.col("words").alias("state"))
    return retriever.search(queries, k=5, beams=16).select("query_id", F.col("rank").cast("bigint").alias("rank"), *NAMES, "item_id")


def stored_index(spark, folder):
    """Prefix tables and lookup, stored and loaded again; (length, sid_0.., item_id), -1 where a column has no place."""
    import uuid

    from sparkloom.shared import shared_dir

    where = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    S.store_index(sids(spark, folder), where)
    trie, lookup = S.load_index(spark, where)
    none = F.lit(-1).cast("bigint")
    out = lookup.select(F.lit(0).cast("bigint").alias("length"), *NAMES, "item_id")
    for k, level in enumerate(trie):
        out = out.unionByName(level.select(F.lit(k + 1).cast("bigint").alias("length"), *(F.col(n) if i <= k else none.alias(n) for i, n in enumerate(NAMES)), none.alias("item_id")))
    return out


def recall_by_label(spark, folder):
    """How often a vector's own id's item is found first or among five, for each label."""
    own = sids(spark, folder).join(S.sid_to_item(sids(spark, folder)).withColumnRenamed("item_id", "target"), NAMES)
    labels = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("query_id"), F.col("label").cast("bigint").alias("label"))
    targets = own.select(F.col("item_id").alias("query_id"), "target").join(labels, "query_id")
    return M.recall_by_group(_search(spark, folder, True), targets, "label", [1, 5])


def beam_seq_markov(spark, folder):
    """T7 with counts: the item after a user's last one, from all pairs of successive items of other events."""
    known = K.events_with_sids(events(spark, folder), sids(spark, folder))
    at = H.positions(known)
    nxt = at.select("user_id", (F.col("position") - 1).alias("position"), *(F.col("sid")[i].alias(f"sid_{i}") for i in range(4)), F.col("from_end").alias("end"))
    steps = at.select("user_id", "position", F.col("item_id").alias("context")).join(nxt, ["user_id", "position"])
    behaviour = steps.filter("end > 1").select("context", *NAMES)  # without each user's target
    queries = steps.filter("end = 1").select(F.col("user_id").alias("query_id"), F.col("context").alias("state"))
    retriever = B.Retriever.of(sids(spark, folder), B.count_scorer(behaviour, CODES), CODES)
    return retriever.search(queries, k=5, beams=10).select("query_id", F.col("rank").cast("bigint").alias("rank"), *NAMES, "item_id")


def text_queries(spark, folder):
    """G1, J14, F12."""
    titles = spark.read.parquet(f"{folder}/part.parquet").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    return K.text_queries(events(spark, folder), titles)


def sequence_queries(spark, folder):
    """G2, J6, F13, P13."""
    return K.sequence_queries(events(spark, folder), sids(spark, folder), 2, 50)


def search_queries(spark, folder):
    """Vectors that ask for their own codes, by their first component."""
    q = K.search_queries(vectors(spark, folder), sids(spark, folder))
    return q.select("query_id", F.round(F.col("q")[0].cast("double"), 6).alias("first"), *NAMES)


def behavior_sequences(spark, folder):
    """A9, W3, F6, P13, J4."""
    return K.behaviour_rows(events(spark, folder), sids(spark, folder), 50)


def _corpus(spark, folder):
    from sparkloom.operators.sid import join_sids

    items = spark.read.parquet(f"{folder}/catalog.parquet").select("item_id", "title", "sub_category", "description")
    meta = K.metadata_rows(join_sids(items, sids(spark, folder))).select("seq_type", F.col("item_id").alias("id"), "input_text", "target_text")
    return meta.unionByName(behavior_sequences(spark, folder).select("seq_type", F.col("user_id").alias("id"), "input_text", "target_text"))


def cpt_corpus(spark, folder):
    """Metadata and behaviour rows together, with their texts."""
    return _corpus(spark, folder)


def behaviour_corpus(spark, folder):
    """of that corpus, the behaviour rows only."""
    return K.behaviour_only(_corpus(spark, folder))


def corpus_rows(spark, folder):
    """Rows by their ordinals in a stored corpus."""
    from sparkloom.operators.catalog import sequential_ids
    from sparkloom.shared import materialize

    stored = materialize(sequential_ids(_corpus(spark, folder), ["seq_type", "id"], "ordinal").sort("ordinal"))
    return K.rows_at(stored, [0, 7, 101]).select("ordinal", "input_text", "target_text")


def corpus_trace(spark, folder):
    """One metadata row, step by step."""
    return K.trace_row(_corpus(spark, folder), "metadata", ["id"])


QUERIES = {
    f.__name__: f
    for f in (
        beam_search_quantizer, beam_unconstrained, hallucination_rate, silent_miss_rate, beam_fills, beam_mask_slots, beam_metrics, recall_by_label, beam_seq_markov, beam_text, stored_index, text_queries,
        sequence_queries, search_queries, behavior_sequences, cpt_corpus, behaviour_corpus, corpus_rows, corpus_trace,
    )
}


def _beam(constrained: bool, k: int = 5) -> str:
    """The unrolled search as CTEs; the last is k(query_id, rank, sid_0.., item_id)."""
    out = ["w0 AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS s, 0.0::DOUBLE AS score FROM embeddings)"]
    for n in range(4):
        prefix = ", ".join(f"sid_{i}" for i in range(n))
        old = "".join(f"w{n}.sid_{i}, " for i in range(n))
        if constrained:
            cols = ", ".join(f"sid_{i}" for i in range(n + 1))
            src = f"w{n} JOIN (SELECT DISTINCT {cols} FROM item2feat) t " + (f"USING ({prefix})" if n else "ON true") + f" JOIN book_{n} b ON b.code = t.sid_{n}"
        else:
            src = f"w{n}, book_{n} b"
        order = ", ".join([*(f"sid_{i}" for i in range(n)), "code"])
        out.append(
            f"w{n + 1} AS (SELECT query_id, {prefix + ', ' if n else ''}code AS sid_{n}, [p[1] - p[2] FOR p IN list_zip(s, c)] AS s, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {order}) AS rn "
            f"FROM (SELECT w{n}.query_id, {old}b.code, w{n}.s, b.c, w{n}.score - list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(w{n}.s, b.c)]) AS score FROM {src})) WHERE rn <= 8)"
        )
    out.append(f"l AS (SELECT {S4}, min(item_id) AS item_id FROM item2feat GROUP BY {S4})")
    out.append(f"k AS (SELECT query_id, rn AS rank, {S4}, coalesce(l.item_id, -1) AS item_id FROM w4 LEFT JOIN l USING ({S4}) WHERE rn <= {k})")
    return SID + ",\n" + ",\n".join(out)


def _filled() -> str:
    """The search of WIDE beams over label 0 as CTEs, with blocked codes; the last is k(query_id, rank, sid_0.., item_id)."""
    out = ["known AS MATERIALIZED (SELECT i.* FROM item2feat i JOIN embeddings ON vec_id = item_id WHERE label = 0)", "w0 AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS s, 0.0::DOUBLE AS score FROM embeddings)"]
    for n in range(4):
        old = "".join(f"w{n}.sid_{i}, " for i in range(n))
        on = lambda t, m, n=n: " AND ".join(f"{t}.sid_{i} = " + (f"w{n}.sid_{i}" if i < n else "b.code") for i in range(m))
        cols = lambda m: ", ".join(f"sid_{i}" for i in range(m))
        live = f"LEFT JOIN (SELECT DISTINCT {cols(n)}, true AS live FROM known) p ON {on('p', n)}" if n else "CROSS JOIN (SELECT true AS live) p"
        out.append(
            f"w{n + 1} AS MATERIALIZED (SELECT query_id, {''.join(f'sid_{i}, ' for i in range(n))}code AS sid_{n}, [x[1] - x[2] FOR x IN list_zip(s, c)] AS s, score, rn FROM "
            f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {''.join(f'sid_{i}, ' for i in range(n))}code) AS rn FROM "
            f"(SELECT w{n}.query_id, {old}b.code, w{n}.s, b.c, w{n}.score + CASE WHEN p.live AND t.ok IS NULL THEN -1e9 ELSE -list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(w{n}.s, b.c)]) END AS score "
            f"FROM w{n} CROSS JOIN book_{n} b LEFT JOIN (SELECT DISTINCT {cols(n + 1)}, true AS ok FROM known) t ON {on('t', n + 1)} {live})) WHERE rn <= {WIDE})"
        )
    out.append(f"l AS (SELECT {S4}, min(item_id) AS item_id FROM known GROUP BY {S4})")
    out.append(f"k AS (SELECT query_id, rn AS rank, {S4}, coalesce(l.item_id, -1) AS item_id FROM w4 LEFT JOIN l USING ({S4}))")
    return SID + ",\n" + ",\n".join(out)


def _slots() -> str:
    """Allowed codes of each slot, for prefixes of items and for those with the last code moved on."""
    parts = []
    for n in range(5):
        names = [f"sid_{i}" for i in range(n)]
        same = lambda t: " AND ".join(f"{t}.{c} = q.{c}" for c in names) or "true"
        known = f"SELECT DISTINCT 'known' AS kind{''.join(', ' + c for c in names)} FROM item2feat"
        if n:
            known += f" UNION ALL SELECT DISTINCT 'moved' AS kind, {', '.join([*names[:-1], f'({names[-1]} + 1) % {CODES}'])} FROM item2feat"
        count = f"(SELECT count(DISTINCT sid_{n}) FROM item2feat t WHERE {same('t')})" if n < 4 else "0"
        parts.append(f"SELECT CAST({n} AS BIGINT) AS slot, kind, {', '.join([*(f'q.{c}' for c in names), *(f'-1 AS sid_{i}' for i in range(n, 4))])}, CASE WHEN {count} = 0 THEN {CODES} ELSE {count} END AS n_allowed FROM ({known}) q")
    return SID + " " + " UNION ALL ".join(parts)


_TOP = f" SELECT count(*) AS n_generated, count(*) FILTER (WHERE item_id < 0) AS n_missing, round(count(*) FILTER (WHERE item_id < 0) / count(*)::DOUBLE, 6) AS rate FROM k WHERE rank = 1"
_SEQ = SID + f""", e AS ({EVENTS}),
s AS (SELECT e.*, '<sid_' || sid_0 || '><sid_' || sid_1 || '><sid_' || sid_2 || '><sid_' || sid_3 || '>' AS t FROM e JOIN item2feat USING (item_id)),
h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp_ms DESC, ordinal DESC) AS f, count(*) OVER (PARTITION BY user_id) AS n FROM s)"""
_BEHAVIOUR = _SEQ + """, b AS (SELECT user_id, 'behavior' AS seq_type, '<seq> ' || string_agg(t, '' ORDER BY timestamp_ms, ordinal) FILTER (WHERE f > 1) AS input_text,
       max(t) FILTER (WHERE f = 1) || '<sid_eos>' AS target_text FROM h WHERE f <= 50 GROUP BY user_id HAVING count(*) >= 2)"""
_CORPUS = _BEHAVIOUR + f""", m AS (SELECT 'metadata' AS seq_type, item_id AS id, '<seq> ' || concat_ws(' | ', 'title: ' || t, CASE WHEN coalesce(sub_category, '') <> '' AND lower(sub_category) <> 'unknown' THEN 'category: ' || sub_category END,
       CASE WHEN d <> '' THEN 'description: ' || d END) AS input_text, '<sid_' || sid_0 || '><sid_' || sid_1 || '><sid_' || sid_2 || '><sid_' || sid_3 || '><sid_eos>' AS target_text
       FROM (SELECT item_id, sub_category, {clean_sql('title', 500)} AS t, {clean_sql('description', 500)} AS d FROM catalog) JOIN item2feat USING (item_id)),
x AS (SELECT * FROM m UNION ALL SELECT seq_type, user_id AS id, input_text, target_text FROM b)"""
SQL = {
    "beam_search_quantizer": _beam(True) + " SELECT * FROM k",
    "beam_unconstrained": _beam(False) + " SELECT * FROM k",
    "hallucination_rate": _beam(False) + _TOP,
    "silent_miss_rate": _filled() + " SELECT count(*) AS n_generated, count(*) FILTER (WHERE item_id < 0) AS n_missing, round(count(*) FILTER (WHERE item_id < 0) / count(*)::DOUBLE, 6) AS rate FROM k",
    "beam_fills": _filled() + f" SELECT query_id, rank, {S4}, item_id FROM k WHERE item_id >= 0",
    "beam_mask_slots": _slots(),
    "beam_metrics": _beam(True, 8) + """, o AS (SELECT i.item_id AS query_id, l.item_id AS target FROM item2feat i JOIN l USING (sid_0, sid_1, sid_2, sid_3)),
h AS (SELECT o.query_id, min(k.rank) AS hit FROM o LEFT JOIN k ON k.query_id = o.query_id AND k.item_id = o.target GROUP BY 1) """ + " UNION ALL ".join(
        f"SELECT 'recall@{n}' AS metric, round(avg(CASE WHEN hit <= {n} THEN 1.0::DOUBLE ELSE 0 END), 6) AS value FROM h UNION ALL "
        f"SELECT 'ndcg@{n}' AS metric, round(avg(CASE WHEN hit <= {n} THEN 1 / log2(hit + 1) ELSE 0 END), 6) AS value FROM h" for n in (1, 5, 8)
    ),
    "stored_index": SID + f" SELECT CAST(0 AS BIGINT) AS length, {S4}, min(item_id) AS item_id FROM item2feat GROUP BY {S4} UNION ALL " + " UNION ALL ".join(
        f"SELECT DISTINCT CAST({k + 1} AS BIGINT) AS length, " + ", ".join(f"sid_{i}" if i <= k else f"-1 AS sid_{i}" for i in range(4)) + ", -1 AS item_id FROM item2feat" for k in range(4)
    ),
    "recall_by_label": _beam(True) + """, o AS (SELECT i.item_id AS query_id, l.item_id AS target FROM item2feat i JOIN l USING (sid_0, sid_1, sid_2, sid_3)),
h AS (SELECT o.query_id, min(k.rank) AS hit FROM o LEFT JOIN k ON k.query_id = o.query_id AND k.item_id = o.target GROUP BY 1)
SELECT CAST(label AS BIGINT) AS label, count(*) AS n_queries, avg(CASE WHEN hit <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS recall_1, avg(CASE WHEN hit <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS recall_5
FROM h JOIN embeddings ON vec_id = query_id GROUP BY 1""",
    "text_queries": f"""
WITH e AS ({EVENTS}), h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp_ms DESC, ordinal DESC) AS f FROM e QUALIFY count(*) OVER (PARTITION BY user_id) >= 3)
SELECT a.user_id, p_name AS query_text, b.item_id AS target FROM h a JOIN h b ON a.user_id = b.user_id AND a.f = 2 AND b.f = 1 JOIN part ON p_partkey = a.item_id WHERE p_name <> ''""",
    "sequence_queries": _SEQ + """
SELECT user_id, '<seq> ' || string_agg(t, '' ORDER BY timestamp_ms, ordinal) FILTER (WHERE f > 1) AS query_text, max(item_id) FILTER (WHERE f = 1) AS target
FROM h WHERE n >= 3 AND f <= 51 GROUP BY user_id""",
    "search_queries": SID + f" SELECT vec_id AS query_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, {S4} FROM embeddings JOIN item2feat ON item_id = vec_id",
    "cpt_corpus": _CORPUS + " SELECT * FROM x",
    "behaviour_corpus": _CORPUS + " SELECT input_text, target_text FROM x WHERE seq_type = 'behavior'",
    "corpus_rows": _CORPUS + ", o AS (SELECT *, row_number() OVER (ORDER BY seq_type, id) - 1 AS ordinal FROM x) SELECT ordinal, input_text, target_text FROM o WHERE ordinal IN (0, 7, 101)",
    "corpus_trace": _CORPUS + """, f AS (SELECT * FROM x WHERE seq_type = 'metadata' ORDER BY id LIMIT 1),
t AS (SELECT *, regexp_extract_all(target_text, '<[a-z0-9_]+>') AS tokens, len(string_split(input_text, ' ')) AS words FROM f)
SELECT unnest(['input_text', 'target_text', 'codes', 'input_words', 'kept_words', 'target_tokens', 'kept_tokens', 'ends']) AS step,
       unnest([input_text, target_text, array_to_string(regexp_extract_all(target_text, '<sid_([0-9]+)>', 1), ' '), CAST(words AS VARCHAR), CAST(least(words, 512) AS VARCHAR),
               CAST(len(tokens) AS VARCHAR), CAST(least(len(tokens), 16) AS VARCHAR), CAST(tokens[-1] = '<sid_eos>' AS VARCHAR)]) AS value FROM t""",
    "behavior_sequences": _BEHAVIOUR + " SELECT * FROM b",
}
