"""Session settings that the plans of this library are made for."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Lets joins on (batch, trace_id, span id) use rows that are dealt by (batch, trace_id) already, so
    that patterns over a table of ``save_spans`` run without a shuffle.  All other settings keep Spark's
    defaults (AQE with skew joins is on).
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, for where they cannot import it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tracelattice-code-")  # the driver serves the file from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/tracelattice_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries within go when each ends, for jobs that write what they shuffle."""
    earlier = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if earlier is None else spark.conf.set(CLEANUP, earlier)
