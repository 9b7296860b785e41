"""Batches, time windows and root spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelattice.functions.scalars import batch_bounds, seconds
from tracelattice.model import Window


def overlaps(start: Column, end: Column, w: Window) -> Column:
    """Inclusive on both sides."""
    return (start <= F.lit(w.end_s)) & (end >= F.lit(w.start_s))


def batches(spans: DataFrame) -> DataFrame:
    """Every batch with the bounds in its name."""
    lo, hi = batch_bounds(F.col("batch"))
    return spans.select("batch").distinct().withColumns({"start_s": lo, "end_s": hi})


def in_window(spans: DataFrame, w: Window | None) -> DataFrame:
    """Rows of batches that overlap the window; with ``batch`` as partition column this prunes folders."""
    if w is None:
        return spans
    lo, hi = batch_bounds(F.col("batch"))
    return spans.where(overlaps(lo, hi, w))


def boundary(start: Column, end: Column, w: Window) -> Column:
    """Batches that overlap the window but reach out of it."""
    return overlaps(start, end, w) & ((start < w.start_s) | (end > w.end_s))


def roots(spans: DataFrame) -> DataFrame:
    """The root span of each trace: no parent; the earliest, then smallest id, if there are several."""
    return (
        spans.where(F.col("parent_span_id").isNull())
        .groupBy("batch", "trace_id")
        .agg(F.min_by(F.struct("span_id", "service", "start_ns", "end_ns"), F.struct("start_ns", "span_id")).alias("r"))
        .select("batch", "trace_id", "r.*")
    )


def traces_in_window(spans: DataFrame, w: Window) -> DataFrame:
    """(batch, trace_id) of traces whose root span overlaps the window."""
    r = roots(in_window(spans, w))
    return r.where(overlaps(seconds(F.col("start_ns")), seconds(F.col("end_ns")), w)).select("batch", "trace_id")


def lowest_start(spans: DataFrame) -> DataFrame:
    return batches(spans).agg(F.min("start_s").alias("min_start_s"))


def services(spans: DataFrame) -> DataFrame:
    return spans.select("service").distinct()


def traces_by_root_service(spans: DataFrame) -> DataFrame:
    """Number of traces of each root service; the full inverse is ``roots`` itself, one row per trace."""
    return roots(spans).groupBy("service").agg(F.count("*").alias("n_traces"), F.min("trace_id").alias("first_trace"))
