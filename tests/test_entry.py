"""The driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).columns == ["key_field", "key_value"]


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["p1_found", "p1_totals", "temporal_split", "sid_collisions", "mips_topk", "behavior_sequences", "best_boxes"])
def test_matches_sql(spark, name):
    import glob
    import os

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([r[c] for c in cols]) for r in df.collect())
    rel = con.sql(entry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(str([r[i] for i in at]) for r in rel.fetchall())
