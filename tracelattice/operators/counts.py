"""Counting tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def traces_and_spans(spans: DataFrame) -> DataFrame:
    """Distinct trace ids and distinct span ids.  Both are dealt by id before they are counted, so no task
    holds all ids; a span id that two traces use counts once."""
    return spans.agg(F.count_distinct("trace_id").alias("n_traces"), F.count_distinct("span_id").alias("n_spans"))


def object_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, n_objects, n_bytes) of the folders below a path, from file metadata alone; the row without
    a bucket is the total.  Files that lie in the path itself are the bucket ''.  Spark's file scans pass over
    empty files, so these are not counted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    root = "/" + path.split("://")[-1].strip("/") + "/"
    inside = F.substring_index(F.concat(F.lit("/"), F.regexp_replace("path", "^[a-z0-9]+:/*", "")), root, -1)
    bucket = F.when(F.contains(inside, F.lit("/")), F.substring_index(inside, "/", 1)).otherwise("")
    return files.rollup(bucket.alias("bucket")).agg(F.count("*").alias("n_objects"), F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("n_bytes"))


def median(df: DataFrame, column: str) -> DataFrame:
    """Mean of the middle two for an even number of rows."""
    return df.agg(F.percentile(column, F.lit(0.5)).alias("median"))
