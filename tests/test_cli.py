"""The command line."""

import pytest

from sparkloom.__main__ import main


def test_list_and_query(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "temporal_split" in capsys.readouterr().out.split()
    assert main(["query", "split_counts", "--tables", "/root/testdata/sf0.001/", "--out", str(tmp_path / "out")]) == 0
    assert {r.split for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"train", "val", "test"}


def test_unknown_query(tmp_path):
    with pytest.raises(SystemExit):
        main(["query", "nothing", "--tables", "x", "--out", str(tmp_path / "out")])
    assert not (tmp_path / "out").exists()
