"""Hierarchical Bloom index over time.

A leaf covers ``granularity`` seconds and holds one filter per batch; each level above is
``granularity`` times as wide and holds the union of its children.  A filter is stored as rows of
(node, bucket, bitmap), so building and uniting them are ordinary aggregations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelattice.functions.scalars import batch_bounds, bloom_size, floor_to
from tracelattice.model import Window
from tracelattice.operators.batches import overlaps
from tracelattice.operators.predicates import property_column

SCHEMA = "level int, start_s bigint, end_s bigint, batch string, bucket bigint, bits binary"
NODE = ["level", "start_s", "end_s", "batch"]


def node_key(nodes: DataFrame) -> list[str]:
    """Runs of an index that grew have filters of their own, also of one node."""
    return [*NODE, "run"] if "run" in nodes.columns else NODE


def positions(value, bits: int, hashes: int):
    """Bit positions of a value: double hashing, from 1."""
    h1, h2 = F.xxhash64(value), F.xxhash64(value, F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(h1 + F.call_function("mod", h2, F.lit(1 << 31)) * i, F.lit(bits)) + 1)


def leaf_split(spans: DataFrame, granularity: int) -> DataFrame:
    """(leaf_start, batch, kind): inclusive if the batch lies in the leaf, early or late if it reaches out."""
    lo, hi = batch_bounds(F.col("batch"))
    b = spans.select("batch").distinct().withColumns({"lo": lo, "hi": hi})
    leaves = b.withColumn("leaf_start", F.explode(F.sequence(floor_to(F.col("lo"), granularity), floor_to(F.col("hi"), granularity), F.lit(granularity))))
    kind = (
        F.when((F.col("lo") >= F.col("leaf_start")) & (F.col("hi") < F.col("leaf_start") + granularity), "inclusive")
        .when(F.col("lo") < F.col("leaf_start"), "early")
        .otherwise("late")
    )
    return leaves.select("leaf_start", "batch", kind.alias("kind"))


def build_leaves(spans: DataFrame, prop: str, granularity: int, n: int = 10_000, fpp: float = 1e-4) -> DataFrame:
    """Level 0: per leaf and batch, the values of spans that start in the leaf."""
    bits, hashes = bloom_size(n, fpp)
    at = floor_to(F.call_function("div", F.col("start_ns"), F.lit(1_000_000_000)), granularity)
    rows = spans.select(at.alias("start_s"), "batch", property_column(prop).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct()
    hit = rows.select("start_s", "batch", F.explode(positions(F.col("v"), bits, hashes)).alias("p"))
    return (
        hit.groupBy(F.lit(0).alias("level"), "start_s", (F.col("start_s") + granularity).alias("end_s"), "batch", F.bitmap_bucket_number("p").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    )


def level_up(nodes: DataFrame, level: int, width: int) -> DataFrame:
    """Union of the children of each node one level up; ``width`` is the new level's."""
    start = floor_to(F.col("start_s"), width)
    return nodes.groupBy(F.lit(level).alias("level"), start.alias("start_s"), (start + width).alias("end_s"), F.lit(None).cast("string").alias("batch"), "bucket").agg(
        F.bitmap_or_agg("bits").alias("bits")
    )


def build(spans: DataFrame, prop: str, granularity: int, fan: int, levels: int, n: int = 10_000, fpp: float = 1e-4) -> DataFrame:
    out = last = build_leaves(spans, prop, granularity, n, fpp)
    for k in range(1, levels):
        last = level_up(last, k, granularity * fan**k)
        out = out.unionByName(last)
    return out


def holding(nodes: DataFrame, value: str, n: int, fpp: float) -> DataFrame:
    """Nodes whose filter has every position of the value."""
    bits, hashes = bloom_size(n, fpp)
    spark = nodes.sparkSession
    p = spark.range(1).select(F.explode(F.array_distinct(positions(F.lit(value), bits, hashes))).alias("p"))
    want = p.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.collect_list(F.bitmap_bit_position("p")).alias("at"))
    buckets = p.select(F.bitmap_bucket_number("p").alias("bucket")).distinct().agg(F.count("*").alias("n_buckets"))
    bit = lambda i: F.getbit(F.conv(F.hex(F.substring("bits", (i / 8).cast("int") + 1, 1)), 16, 10).cast("int"), (i % 8).cast("int")) == 1
    full = nodes.join(F.broadcast(want), "bucket").where(F.forall("at", bit))  # at most ``hashes`` rows
    return full.groupBy(*node_key(nodes)).agg(F.count("*").alias("got")).join(F.broadcast(buckets), F.col("got") == F.col("n_buckets"), "left_semi").select(*NODE)


def probe(nodes: DataFrame, value: str, levels: int, w: Window | None = None, n: int = 10_000, fpp: float = 1e-4) -> DataFrame:
    """Candidate batches, from the top level down; no batch that holds the value is missed."""
    rows = nodes if w is None else nodes.where(overlaps(F.col("start_s"), F.col("end_s") - 1, w))
    above = None
    for k in reversed(range(levels)):
        level = rows.where(F.col("level") == k)
        if above is not None:
            inside = (F.col("start_s") >= F.col("p_start")) & (F.col("start_s") < F.col("p_end")) & (F.col("p_first") == F.col("start_s") - F.pmod(F.col("start_s"), F.col("p_end") - F.col("p_start")))
            level = level.join(above, inside, "left_semi")
        above = holding(level, value, n, fpp).select(F.col("start_s").alias("p_start"), F.col("end_s").alias("p_end"), F.col("start_s").alias("p_first"), "batch")
    return above.select("batch").where(F.col("batch").isNotNull()).distinct()


def compact(nodes: DataFrame) -> DataFrame:
    """One filter for each node: the union of those of all runs."""
    return nodes.groupBy(*NODE, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def widest(nodes: DataFrame) -> DataFrame:
    """Bounds of the root: the widest node, the first of these."""
    top = F.max_by(F.struct("start_s", "end_s"), F.struct(F.col("end_s") - F.col("start_s"), -F.col("start_s")))
    return nodes.agg(top.alias("r")).select("r.*")


def combine(left: DataFrame, right: DataFrame, how: str, by: list[str]) -> DataFrame:
    """Bitmaps (columns ``by``, bits) of two tables put together by ``and``, ``or`` or ``xor``; a bitmap that
    one table lacks is empty there."""
    op = {"and": np.bitwise_and, "or": np.bitwise_or, "xor": np.bitwise_xor}[how]

    @F.pandas_udf("binary")
    def merged(a: pd.Series, b: pd.Series) -> pd.Series:
        as_bits = lambda x, y: np.frombuffer(x if x is not None else bytes(len(y)), np.uint8)
        return pd.Series([op(as_bits(x, y), as_bits(y, x)).tobytes() for x, y in zip(a, b)], dtype=object)

    both = left.select(*by, F.col("bits").alias("a")).join(right.select(*by, F.col("bits").alias("b")), by, "full")
    return both.select(*by, merged("a", "b").alias("bits"))


def verify(spans: DataFrame, batches: DataFrame, prop: str, value: str) -> DataFrame:
    """Exact traces among the candidate batches."""
    return spans.join(batches, "batch", "left_semi").where(property_column(prop).cast("string") == value).select("batch", "trace_id").distinct()


def lookup(spans: DataFrame, prop: str, value: str) -> DataFrame:
    """The first batch that holds a trace or span id."""
    return spans.where(F.col(prop) == value).agg(F.min("batch").alias("batch"))
