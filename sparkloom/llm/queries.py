"""The queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.llm.mixture import describe, similarity_clusters
from sparkloom.llm.neighbours import neighbours
from sparkloom.llm.overlaps import cross_split_pairs, overlap_report
from sparkloom.llm.packing import pack
from sparkloom.llm.pairs import pair_counts
from sparkloom.llm.products import product_groups, same_product
from sparkloom.llm.sentences import sentences
from sparkloom.llm.sequences import frequent_sequences
from sparkloom.llm.tokens import encode
from sparkloom.shared import materialize


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p2_sequences(spark, folder):
    """Frequent sequences of three items with their users."""
    found = frequent_sequences(_table(spark, folder, "interactions"))
    return found.toDF("asin_1", "asin_2", "asin_3", "n_users")


def p2_found(spark, folder):
    return p2_sequences(spark, folder).drop("n_users")


def p3_pairs(spark, folder):
    """Pairs above the thresholds with counts, ratio to chance and false-discovery rate."""
    return pair_counts(_table(spark, folder, "interactions"))


def p3_counts(spark, folder):
    """The same pairs with their counts and ratio only, which SQL can say too."""
    return pair_counts(_table(spark, folder, "interactions"), surprise=False).select("asin_a", "asin_b", "n_ab", "n_a", "n_b", F.round("ratio", 6).alias("ratio"))


def p3_found(spark, folder):
    return p3_pairs(spark, folder).select("asin_a", "asin_b")


def p4_found(spark, folder):
    return similarity_clusters(_table(spark, folder, "embeddings_b2")).labels.select("first_item_id", "item_id")


def p4_clusters(spark, folder):
    """Size and most typical items of each cluster."""
    return describe(similarity_clusters(_table(spark, folder, "embeddings_b2")))


def p5_found(spark, folder):
    pairs = cross_split_pairs(_table(spark, folder, "catalog"))
    a, b = F.col("eval_id"), F.col("train_id")
    return pairs.select(F.least(a, b).alias("item_id_a"), F.greatest(a, b).alias("item_id_b"))


def p5_report(spark, folder):
    """Rows of each evaluation split and main category that occur in training, and their pairs."""
    rows = _table(spark, folder, "catalog")
    return overlap_report(rows, cross_split_pairs(rows))


def p6_found(spark, folder):
    return same_product(_table(spark, folder, "items"))


def p6_groups(spark, folder):
    """The product of every listed key."""
    return product_groups(_table(spark, folder, "items"))


def p7_neighbours(spark, folder):
    """The five most similar items of every item."""
    return neighbours(_table(spark, folder, "embeddings_b2"))


def p7_found(spark, folder):
    a, b = F.col("item_id"), F.col("neighbour_id")
    return p7_neighbours(spark, folder).select(F.least(a, b).alias("item_id_a"), F.greatest(a, b).alias("item_id_b")).distinct()


def p8_ids(spark, folder):
    """Token ids of every document."""
    return encode(_table(spark, folder, "documents"))


def p9_pack(spark, folder):
    """The container of every document, for each capacity, sized by the tokenizer that its setting names."""
    docs, limits = _table(spark, folder, "documents"), _table(spark, folder, "pack_limits")
    out = None
    for (name,) in sorted(limits.select("tokenizer").distinct().collect()):  # a few settings
        lengths = materialize(encode(docs, name=name, lengths_only=True))
        packed = pack(lengths, limits.filter(F.col("tokenizer") == name))
        out = packed if out is None else out.unionByName(packed)
    return out


def p10_found(spark, folder):
    return sentences(_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_sequences, p3_found, p3_pairs, p3_counts, p4_found, p4_clusters, p5_found, p5_report, p6_found, p6_groups, p7_found, p7_neighbours, p8_ids, p9_pack, p10_found)}

_P2 = """
WITH v AS (SELECT DISTINCT user_id AS u, parent_asin AS a, timestamp_ms AS t FROM interactions
           WHERE user_id <> '' AND parent_asin <> '' AND timestamp_ms > 0),
need AS (SELECT greatest(12, ceil(0.02 * count(DISTINCT u) - 1e-9)) AS n FROM v),
w AS (SELECT v.* FROM v JOIN (SELECT a FROM v GROUP BY a HAVING count(DISTINCT u) >= (SELECT n FROM need)) k USING (a)),
f AS (SELECT u, a, min(t) AS first_t, max(t) AS last_t FROM w GROUP BY u, a),
p AS (SELECT f.u, f.a, w.a AS b, min(w.t) AS e FROM f JOIN w ON f.u = w.u AND f.a <> w.a AND w.t > f.first_t GROUP BY 1, 2, 3)
SELECT p.a AS asin_1, p.b AS asin_2, f.a AS asin_3{n}
FROM p JOIN f ON p.u = f.u AND f.a <> p.a AND f.a <> p.b AND f.last_t > p.e
GROUP BY p.a, p.b, f.a HAVING count(*) >= (SELECT n FROM need)"""
_P3 = """
WITH b AS (SELECT DISTINCT user_id AS u, parent_asin AS a FROM interactions WHERE user_id <> '' AND parent_asin <> ''),
n AS (SELECT a, count(*) AS n FROM b GROUP BY a), total AS (SELECT count(DISTINCT u) AS n FROM b)
SELECT x.a AS asin_a, y.a AS asin_b{n}
FROM b x JOIN b y ON x.u = y.u AND x.a < y.a JOIN n na ON na.a = x.a JOIN n nb ON nb.a = y.a, total
GROUP BY x.a, y.a, na.n, nb.n, total.n
HAVING count(*) >= 20 AND count(*) * total.n * 1.0 / (na.n * nb.n) >= 4"""
_P4 = """
WITH RECURSIVE v AS (SELECT DISTINCT item_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings_b2
                     WHERE len(embedding) = 64 AND list_bool_or([x <> 0 FOR x IN embedding])),
n AS (SELECT item_id, e, sqrt(list_inner_product(e, e)) AS l FROM v),
links AS (SELECT a.item_id AS i, b.item_id AS j FROM n a JOIN n b ON a.item_id <> b.item_id
          WHERE list_inner_product(a.e, b.e) / (a.l * b.l) >= 0.85),
reach AS (SELECT DISTINCT i AS root, i AS item_id FROM links
          UNION SELECT reach.root, links.j FROM reach JOIN links ON links.i = reach.item_id WHERE links.j > reach.root),
first AS (SELECT item_id, min(root) AS first_item_id FROM reach GROUP BY item_id)
SELECT first_item_id, item_id FROM first
WHERE first_item_id IN (SELECT first_item_id FROM first GROUP BY 1 HAVING count(*) >= 4)"""
SQL = {
    "p4_found": _P4,
    "p2_sequences": _P2.format(n=", count(*) AS n_users"),
    "p2_found": _P2.format(n=""),
    "p3_found": _P3.format(n=""),
    "p3_counts": _P3.format(n=", count(*) AS n_ab, na.n AS n_a, nb.n AS n_b, round(count(*) * total.n * 1.0::DOUBLE / (na.n * nb.n), 6) AS ratio"),
}
