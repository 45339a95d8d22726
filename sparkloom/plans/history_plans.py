"""User histories, samples, splits and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import batching as B
from sparkloom.operators import history as H
from sparkloom.operators import sampling as P
from sparkloom.plans.common import EVENTS, events
from sparkloom.plans.registry import table


def history_positions(spark, folder):
    """W1, W2, W4, W5, A10, J11."""
    return H.positions(events(spark, folder)).select("user_id", "ordinal", "item_id", "position", "n_events", "from_end")


def purchase_positions(spark, folder):
    """W1 with heavy ties in time: orders of customers, told apart by the item."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    rows = lines.join(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = ("o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return H.positions(rows, "o_custkey", order).select("o_custkey", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "position")


def min_history_users(spark, folder):
    """users with more than 70 events."""
    return H.with_min_history(events(spark, folder), 70).select("user_id").distinct()


def last_events(spark, folder):
    """The last 20 events of each user."""
    return H.last_events(events(spark, folder), 20).select("user_id", "ordinal", "item_id")


def ordered_chains(spark, folder):
    """The last 50 items of each user in order."""
    return H.chains(events(spark, folder), "item_id", 50, min_length=2)


def sampled_users(spark, folder):
    """40 users by seeded hash, and their events."""
    e = events(spark, folder)
    users = P.sample_exact(e.select("user_id").distinct(), "user_id", 40, 42)
    return e.join(users, "user_id", "left_semi").select("user_id", "ordinal")


def stratified_sample(spark, folder):
    """20 events of each type."""
    return P.sample_per_stratum(table(spark, folder, "events").select("event_type", "event_id"), "event_type", "event_id", 20, 42)


def sampled_items(spark, folder):
    """300 items with an image by seeded hash, in its order."""
    rows = table(spark, folder, "catalog").filter("has_image").select("item_id")
    return P.shuffled(P.sample_exact(rows, "item_id", 300, 7), "item_id", 7, "place")


def shuffled_items(spark, folder):
    """U7."""
    return P.shuffled(table(spark, folder, "catalog").select("item_id"), "item_id", 42)


def tail_split(spark, folder):
    """The last hundredth of the shuffled items is for validation."""
    return P.tail_split(shuffled_items(spark, folder), 0.01).select("item_id", "part")


def first_rows(spark, folder):
    """A smoke set of the first 100 in order."""
    return shuffled_items(spark, folder).filter("ordinal < 100").select("item_id")


def _slots(spark, folder):
    c = table(spark, folder, "catalog")
    return B.paired_slots(c.filter("split = 'train'").select("item_id"), c.filter("has_image AND split <> 'train'").select("item_id"), "item_id", 42)


def paired_examples(spark, folder):
    """U8, U10, A16."""
    return _slots(spark, folder)


def stratified_batches(spark, folder):
    """Batches of 16, each of one mode."""
    return B.uniform_batches(_slots(spark, folder), 16, 42, 1).select("item_id", "mode", "batch_id", "place")


def ragged_batches(spark, folder):
    """The same with the last, smaller batches."""
    return B.uniform_batches(_slots(spark, folder), 16, 42, 1, drop_last=False).select("item_id", "mode", "batch_id", "place")


def mixed_batches(spark, folder):
    """Batches that mix modes, among the uniform ones (none) and among plain cuts of 15 of the alternating order (all)."""
    slots = _slots(spark, folder)
    plain = slots.withColumn("batch_id", F.floor(F.col("ordinal") / 15))
    count = lambda df, kind: B.mixed_batches(df).agg(F.lit(kind).alias("kind"), F.count("*").alias("n_mixed"))
    return count(B.uniform_batches(slots, 16, 42, 1), "uniform").unionByName(count(plain, "plain"))


QUERIES = {
    f.__name__: f
    for f in (
        history_positions, purchase_positions, min_history_users, last_events, ordered_chains, sampled_users, stratified_sample, shuffled_items, tail_split, first_rows,
        sampled_items, paired_examples, stratified_batches, ragged_batches, mixed_batches,
    )
}
_E = f"WITH e AS ({EVENTS}) "
_PAIRED = """
WITH a AS (SELECT item_id, row_number() OVER (ORDER BY md5('42:' || item_id), item_id) - 1 AS slot FROM catalog WHERE split = 'train'),
b AS (SELECT item_id, row_number() OVER (ORDER BY md5('42:' || item_id), item_id) - 1 AS slot FROM catalog WHERE has_image AND split <> 'train'),
n AS (SELECT least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS n),
p AS (SELECT item_id, 'sequence' AS mode, slot, 2 * slot AS ordinal FROM a, n WHERE slot < n.n
      UNION ALL SELECT item_id, 'search' AS mode, slot, 2 * slot + 1 AS ordinal FROM b, n WHERE slot < n.n)"""
_BATCH = _PAIRED + """,
k AS (SELECT item_id, mode, row_number() OVER (PARTITION BY mode ORDER BY md5('43:' || mode || ':' || slot), slot) - 1 AS i FROM p),
g AS (SELECT item_id, mode, 2 * (i // 16) + CASE mode WHEN 'search' THEN 1 ELSE 0 END AS batch_id, i % 16 AS place FROM k)"""
SQL = {
    "history_positions": _E + """
SELECT user_id, ordinal, item_id, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY user_id) AS n_events,
       count(*) OVER (PARTITION BY user_id) - (row_number() OVER w - 1) AS from_end
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY timestamp_ms, ordinal)""",
    "purchase_positions": """
SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS position
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "min_history_users": _E + "SELECT user_id FROM e GROUP BY 1 HAVING count(*) >= 71",
    "last_events": _E + "SELECT user_id, ordinal, item_id FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY timestamp_ms DESC, ordinal DESC) <= 20",
    "ordered_chains": _E + """, k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY timestamp_ms DESC, ordinal DESC) <= 50)
SELECT user_id, list(item_id ORDER BY timestamp_ms, ordinal) AS chain FROM k GROUP BY 1 HAVING count(*) >= 2""",
    "sampled_users": _E + ", u AS (SELECT DISTINCT user_id FROM e ORDER BY md5('42:' || user_id), user_id LIMIT 40) SELECT user_id, ordinal FROM e SEMI JOIN u USING (user_id)",
    "stratified_sample": "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_type || ':' || event_id), event_id) <= 20",
    "shuffled_items": "SELECT item_id, row_number() OVER (ORDER BY md5('42:' || item_id), item_id) - 1 AS ordinal FROM catalog",
    "tail_split": """
WITH o AS (SELECT item_id, row_number() OVER (ORDER BY md5('42:' || item_id), item_id) - 1 AS i, count(*) OVER () AS n FROM catalog)
SELECT item_id, CASE WHEN i >= n - greatest(1, floor(n * 0.01)) THEN 'val' ELSE 'train' END AS part FROM o""",
    "first_rows": "SELECT item_id FROM catalog ORDER BY md5('42:' || item_id), item_id LIMIT 100",
    "paired_examples": _PAIRED + " SELECT * FROM p",
    "stratified_batches": _BATCH + " SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY batch_id) = 16",
    "ragged_batches": _BATCH + " SELECT * FROM g",
    "mixed_batches": _BATCH + """
SELECT 'uniform' AS kind, (SELECT count(*) FROM (SELECT batch_id FROM g GROUP BY 1 HAVING count(DISTINCT mode) > 1)) AS n_mixed
UNION ALL SELECT 'plain', (SELECT count(*) FROM (SELECT ordinal // 15 FROM p GROUP BY 1 HAVING count(DISTINCT mode) > 1))""",
    "sampled_items": """
WITH s AS (SELECT item_id FROM catalog WHERE has_image ORDER BY md5('7:' || item_id), item_id LIMIT 300)
SELECT item_id, row_number() OVER (ORDER BY md5('7:' || item_id), item_id) - 1 AS place FROM s""",
}
