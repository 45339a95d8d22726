"""Tables in the shared folder."""

import os
from types import SimpleNamespace

import pytest

from sparkloom import shared


def test_tables_live_until_they_are_released(spark):
    df = shared.materialize(spark.range(5))
    (path,) = {os.path.dirname(p.removeprefix("file://")) for p in df.inputFiles()}
    assert df.count() == 5 and os.path.isdir(path)
    shared.release(df, None, spark.range(3))
    assert not os.path.exists(path)
    shared.release(df)


def test_a_cluster_needs_a_shared_folder():
    session = lambda master, **conf: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf.get("dir", d)), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(session("spark://host:7077"))
    assert shared.shared_dir(session("spark://host:7077", dir="file:///share/")) == "file:///share"
    assert shared.shared_dir(session("local[4]")).startswith("file:")
