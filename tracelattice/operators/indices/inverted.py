"""Inverted index: (attr_key, attr_value) to the traces that carry it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelattice.functions.scalars import batch_bounds
from tracelattice.model import Window
from tracelattice.operators.batches import in_window

SCHEMA = "attr_key string, attr_value string, batch string, trace_id string"


def build(spans: DataFrame, keys: list[str] | None = None, after: int | None = None) -> DataFrame:
    """Distinct (attr_key, attr_value, batch, trace_id); every occurrence of a key counts.

    ``after``: only batches that end later than this second, for an incremental run.
    """
    if after is not None:
        spans = spans.where(batch_bounds(F.col("batch"))[1] > after)
    rows = spans.select("batch", "trace_id", F.explode("attributes").alias("a"))
    if keys:
        rows = rows.where(F.col("a.key").isin(keys))
    return rows.select(F.col("a.key").alias("attr_key"), F.col("a.value").alias("attr_value"), "batch", "trace_id").distinct()


def layout(index: DataFrame) -> DataFrame:
    """Rows by key and value, those of one value in up to 64 tasks."""
    spread = index.repartition("attr_key", "attr_value", F.pmod(F.xxhash64("trace_id"), F.lit(64)))
    return spread.sortWithinPartitions("attr_key", "attr_value")


def save(arranged: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Folders by key, rows sorted by value: a probe opens one folder and skips row groups by their
    statistics.  Values are no folders, since a key may have millions of them."""
    arranged.write.mode("append").partitionBy("attr_key").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write(index: DataFrame, path: str) -> None:
    save(layout(index), path)


def probe(index: DataFrame, key: str, value: str, w: Window | None = None) -> DataFrame:
    return in_window(index.where((F.col("attr_key") == key) & (F.col("attr_value") == value)), w).select("batch", "trace_id").distinct()


def large_values(index: DataFrame, key: str, least_bytes: int, bytes_per_id: int = 32) -> DataFrame:
    """Values whose ids fill an object, with the bounds of their batches."""
    lo, hi = batch_bounds(F.col("batch"))
    return (
        index.where(F.col("attr_key") == key)
        .groupBy("attr_value")
        .agg((F.count("*") * bytes_per_id).alias("n_bytes"), F.min(lo).alias("start_s"), F.max(hi).alias("end_s"))
        .where(F.col("n_bytes") >= least_bytes)
    )
