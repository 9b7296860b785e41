"""Intermediate tables in the folder that all executors share.

The folder is the one named by ``spark.checkpoint.dir``.  Where a session has no such setting (tests,
notebooks in local mode) a temporary folder is used; on a real cluster that would be a folder other
machines cannot see, so there the setting is required.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tracelattice-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
        _LOCAL[app] = f"file://{path}"
    return _LOCAL[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{folder(spark)}/{label}-{uuid.uuid4().hex}"


def folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return f"{shared_dir(spark)}/tracelattice/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Removes all intermediate tables of this application.  Results read them until they are written, so
    this is for the end of a job; tables of an application that died are left in a folder of its name."""
    delete(spark, folder(spark))


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, label: str, at: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, freezes row identities, survives lost executors."""
    spark = df.sparkSession
    path = at or new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
