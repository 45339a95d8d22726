"""Per-key totals: hot keys, nulls, empty keys, repeats, empty tables, clashing columns."""

from collections import Counter

from sparkloom.operators.dense_totals import dense_totals, heavy_keys

DDL = "user_id string, parent_asin string, rating double, helpful_vote bigint, timestamp_ms bigint, key_value string, n_rows int"


def rows(spark, data):
    return spark.createDataFrame([(*r, "x", 1) for r in data], DDL)


def test_totals_match_a_plain_count(spark):
    data = [(f"u{i % 7 if i % 3 else 0}", f"a{i % 11}", float(i % 5), i, i) for i in range(500)] + [(None, "", None, None, None)] * 3
    got = {(r.key_field, r.key_value): r for r in dense_totals(rows(spark, data), ["user_id", "parent_asin"], blocks=3).collect()}
    users = Counter(r[0] for r in data)
    assert {k[1]: r.n_rows for k, r in got.items() if k[0] == "user_id"} == dict(users)
    one = got[("user_id", "u0")]
    own = [r for r in data if r[0] == "u0"]
    assert (one.rating_sum, one.helpful_votes, one.first_ms, one.last_ms) == (sum(r[2] for r in own), sum(r[3] for r in own), min(r[4] for r in own), max(r[4] for r in own))
    none = got[("user_id", None)]
    assert (none.n_rows, none.n_rated, none.rating_sum, none.helpful_votes, none.first_ms) == (3, 0, 0.0, 0, None)


def test_blocks_follow_the_rows(spark, monkeypatch):
    from sparkloom.operators import dense_totals as D

    data = [(f"u{i % 90}", f"a{i}", 1.0, 1, i) for i in range(300)]
    want = {tuple(r) for r in dense_totals(rows(spark, data), ["user_id", "parent_asin"], blocks=1).collect()}
    monkeypatch.setattr(D, "BLOCK_ROWS", 10)
    assert {tuple(r) for r in dense_totals(rows(spark, data), ["user_id", "parent_asin"]).collect()} == want and len(want) == 390


def test_empty_table(spark):
    assert dense_totals(rows(spark, []), ["user_id"]).collect() == []
    assert heavy_keys(rows(spark, []), ["user_id"]).collect() == []


def test_heavy_keys_count_all_rows_but_skip_null_and_empty(spark):
    data = [("hot", "a", 1.0, 0, 1)] * 5 + [(None, "b", 1.0, 0, 1)] * 45 + [("", "c", 1.0, 0, 1)] * 50
    got = {tuple(r) for r in heavy_keys(rows(spark, data), ["user_id", "parent_asin"]).collect()}
    assert got == {("user_id", "hot"), ("parent_asin", "a"), ("parent_asin", "b"), ("parent_asin", "c")}


def test_share_is_a_lower_bound_inclusive(spark):
    data = [("x", "a", 1.0, 0, 1)] * 3 + [(f"u{i}", f"a{i}", 1.0, 0, 1) for i in range(97)]
    assert ("user_id", "x") in {tuple(r) for r in heavy_keys(rows(spark, data), ["user_id"]).collect()}
