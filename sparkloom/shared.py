"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Of a DataFrame that materialize() returned: a reference to it, and its table.
_TABLES: dict[int, tuple[weakref.ref, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where it is unset and all tasks run in this process, as in tests."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return "file://" + _OWN["dir"]


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again.

    Unlike a cached or locally checkpointed DataFrame, the result outlives the
    executors that made it. The table is removed by release(), or when the
    application's shared folder is removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLES[id(out)] = (weakref.ref(out), path)
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes tables that materialize() wrote and that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        ref, path = _TABLES.pop(id(df), (None, ""))
        if ref is not None and ref() is df:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application."""
    import os
    import zipfile

    sc = spark.sparkContext
    if _OWN.get("shipped") == sc.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = urlparse(shared_dir(spark))
    if folder.scheme not in ("", "file"):
        return  # the cluster has the package from --py-files
    os.makedirs(folder.path, exist_ok=True)
    path = f"{folder.path}/sparkloom-{uuid.uuid4().hex}.zip"
    with open(path, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("sparkloom", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _OWN["shipped"] = sc.applicationId
