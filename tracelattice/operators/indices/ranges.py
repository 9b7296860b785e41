"""Range index: values by fixed time nodes, sorted within each node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelattice.functions.scalars import floor_to, seconds
from tracelattice.model import Compare, Window
from tracelattice.operators.predicates import OPS, property_column

NODE_S, NODES_PER_SUMMARY = 100, 5  # fixed values: seconds of a node, nodes of a summary

EXACT = "decimal(38,9)"
SCHEMA = "attr string, node_start bigint, value_str string, value_num double, batch string, trace_id string, start_s bigint"


def build(spans: DataFrame, prop: str, node_s: int = NODE_S, after: int | None = None) -> DataFrame:
    """(attr, node_start, value_str, value_num, batch, trace_id, start_s); spans without a value have no row."""
    at = seconds(F.col("start_ns"))
    rows = spans.select("batch", "trace_id", at.alias("start_s"), property_column(prop).cast("string").alias("value_str"))
    rows = rows.where(F.col("value_str").isNotNull())
    if after is not None:
        rows = rows.where(F.col("start_s") >= after)
    return rows.select(
        F.lit(prop).alias("attr"), floor_to(F.col("start_s"), node_s).alias("node_start"), "value_str",
        F.col("value_str").try_cast("double").alias("value_num"), "batch", "trace_id", "start_s",
    )


def layout(index: DataFrame) -> DataFrame:
    """Range partitions of (node, value): Parquet statistics are the summaries."""
    return index.repartitionByRange("node_start", "value_num", "trace_id").sortWithinPartitions("node_start", "value_num", "value_str")


def save(arranged: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    arranged.write.mode("append").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write(index: DataFrame, path: str) -> None:
    save(layout(index), path)


def summaries(index: DataFrame, node_s: int = NODE_S, nodes: int = NODES_PER_SUMMARY) -> DataFrame:
    """Smallest and largest value of each node, under its summary's start."""
    return index.groupBy(floor_to(F.col("node_start"), node_s * nodes).alias("summary_start"), "node_start").agg(
        F.min("value_num").alias("min_value"), F.max("value_num").alias("max_value"), F.count("*").alias("n_rows")
    )


def probe(index: DataFrame, prop: str, compare: Compare, value: str, w: Window | None = None, node_s: int = NODE_S, lexical: bool = False) -> DataFrame:
    """Traces with a span that satisfies the comparison; numbers compare as numbers unless ``lexical``.

    ``value_num`` is the nearest double, so it only prunes, with its bound included; the text decides, as a
    decimal of 9 places.
    """
    rows = index.where(F.col("attr") == prop)
    if w is not None:
        rows = rows.where((F.col("node_start") >= w.start_s - w.start_s % node_s) & (F.col("node_start") <= w.end_s) & F.col("start_s").between(w.start_s, w.end_s))
    if lexical:
        rows = rows.where(OPS[compare](F.col("value_str"), F.lit(str(value))))
    else:
        near = {Compare.EQ: F.col("value_num") == float(value), Compare.LT: F.col("value_num") <= float(value), Compare.GT: F.col("value_num") >= float(value)}[compare]
        rows = rows.where(near).where(OPS[compare](F.col("value_str").try_cast(EXACT), F.lit(str(value)).cast(EXACT)))
    return rows.select("batch", "trace_id").distinct()


def split_node(sizes: list[int], limit: int) -> list[list[int]]:
    """Positions of rows dealt to nodes of at most ``limit`` bytes, in order; a larger row stands alone."""
    out, room = [[]], limit
    for i, n in enumerate(sizes):
        if out[-1] and n > room:
            out.append([])
            room = limit
        out[-1].append(i)
        room -= n
    return out
