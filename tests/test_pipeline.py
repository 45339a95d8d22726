"""Stages in order, written and read again."""

import pytest

from sparkloom.pipeline import CATALOGUE, Stage, run


def test_catalogue_stages(spark, tmp_path):
    day = 86_400_000
    spark.createDataFrame([("B", "b saw saw"), ("A", "<b>a</b>"), ("B", "a saw"), ("", "x"), (None, "y"), ("C", None)], "parent_asin string, title string").write.parquet(f"{tmp_path}/items.parquet")
    spark.createDataFrame([("u", "A", 100 * day), ("v", "B", 50 * day), ("v", "Z", 60 * day)], "user_id string, parent_asin string, timestamp_ms bigint").write.parquet(f"{tmp_path}/interactions.parquet")
    out = run(spark, CATALOGUE[::-1], str(tmp_path), f"{tmp_path}/out")
    assert set(out) == {s.name for s in CATALOGUE}
    assert sorted((r.item_id, r.parent_asin, r.split) for r in out["numbered"].collect()) == [(0, "A", "test"), (1, "B", "train"), (2, "C", "train")]
    assert sorted(map(tuple, out["texts"].collect())) == [(0, "a"), (1, "b saw"), (2, "")]
    assert sorted(r.parent_asin for r in out["reviews"].collect()) == ["A", "B"]
    assert spark.read.parquet(f"{tmp_path}/out/texts.parquet").count() == 3


@pytest.mark.parametrize("stages", [[Stage("a", ("b",), None), Stage("b", ("a",), None)], [Stage("a", (), None), Stage("a", (), None)]])
def test_impossible_stages(spark, tmp_path, stages):
    with pytest.raises(ValueError):
        run(spark, stages, str(tmp_path), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
