"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder: `spark.checkpoint.dir`, or a folder of our own where that is unset on one machine.

    On a cluster executors would each write to their own disk, so there it has to be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="heddle-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return f"file://{_OWN[app]}"


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    This cuts the lineage like a reliable checkpoint, so a lost executor costs a
    re-read and not a recomputation, and it is columnar and compressed.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's own file-system layer."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_tables(*tables: DataFrame) -> None:
    """Delete the files of tables made by `materialize` that nothing reads any more."""
    for t in tables:
        for f in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            drop_path(t.sparkSession, f)


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small file, or None if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(p):
        return None
    stream = store.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file under a name of its own and rename it, so that a reader finds it whole or not at all."""
    own = f"{path}.{uuid.uuid4().hex}"
    target, p = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, own))
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = store.create(p, True)
    stream.write(data)
    stream.close()
    if not store.rename(p, target):
        store.delete(p, False)  # another run was first
