"""Incremental index maintenance with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["attr_key", "attr_value", "batch", "trace_id"]
SCHEMA = "attr_key string, attr_value string, trace_id string, run int, batch string"


def maintain(stream: DataFrame, to_rows: Callable[[DataFrame], DataFrame], index_path: str, checkpoint: str) -> None:
    """Append what each micro-batch adds to an inverted index; handles all data there is, then returns.

    Each micro-batch is written under its own id, in folders by batch, so a retried one replaces itself.
    Rows that an earlier run wrote stay out by an anti-join with the folders of the batches that this
    micro-batch holds; the rest of the index is not opened.  The names of these batches come to the driver:
    one for each object that the trigger took at most.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = to_rows(batch).select(*KEYS).distinct()
        if number:
            held = [r["batch"] for r in rows.select("batch").distinct().collect()]
            seen = spark.read.schema(SCHEMA).option("basePath", index_path).parquet(index_path).where((F.col("run") < number) & F.col("batch").isin(held))
            rows = rows.join(seen, KEYS, "left_anti")
        rows.write.mode("overwrite").partitionBy("batch").parquet(f"{index_path}/run={number}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_index(spark: SparkSession, index_path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(index_path).select(*KEYS)


def compact(spark: SparkSession, index_path: str, to: str) -> None:
    """The same rows in one run below another path, for an index of many runs; the stream goes on there."""
    read_index(spark, index_path).repartition("batch").write.partitionBy("batch").parquet(f"{to}/run=0")
