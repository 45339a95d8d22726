"""Per-key totals of interactions, a few keys of which hold most rows."""

from __future__ import annotations

from sparkloom.operators.dense_totals import dense_totals, heavy_keys
from sparkloom.plans.registry import table

KEYS = ["user_id", "parent_asin"]


def p1_found(spark, folder):
    return heavy_keys(table(spark, folder, "interactions"), KEYS)


def p1_totals(spark, folder):
    return dense_totals(table(spark, folder, "interactions"), KEYS)


QUERIES = {"p1_found": p1_found, "p1_totals": p1_totals}
_TOTALS = """
SELECT '{k}' AS key_field, {k} AS key_value, count(*) AS n_rows, count(rating) AS n_rated, coalesce(sum(rating), 0) AS rating_sum,
       CAST(coalesce(sum(helpful_vote), 0) AS BIGINT) AS helpful_votes, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms
FROM interactions GROUP BY {k}"""
_FOUND = """
SELECT '{k}' AS key_field, {k} AS key_value FROM interactions WHERE {k} <> ''
GROUP BY {k} HAVING count(*) >= 0.03 * (SELECT count(*) FROM interactions)"""
SQL = {
    "p1_found": " UNION ALL ".join(_FOUND.format(k=k) for k in KEYS),
    "p1_totals": " UNION ALL ".join(_TOTALS.format(k=k) for k in KEYS),
}
