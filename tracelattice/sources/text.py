"""The text form of traces: a header line per trace, then ``parent:span:service:hash`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "Trace ID: "  # fixed value of the format


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(batch, trace_id, parent_span_id, span_id, service, subtree_hash); malformed lines give no row."""
    blocks = spark.read.option("lineSep", HEADER).text(path).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("batch"))
    return parse_blocks(blocks)


def parse_blocks(blocks: DataFrame) -> DataFrame:
    lines = F.split("value", "\n")
    rows = blocks.select("batch", F.regexp_replace(lines[0], "^(" + HEADER + ")?|:$", "").alias("trace_id"), F.explode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line"))
    part = F.split("line", ":")
    return rows.where((F.size(part) == 4) & (F.length("trace_id") == 32)).select(
        "batch", "trace_id", F.nullif(part[0], F.lit("")).alias("parent_span_id"), part[1].alias("span_id"), part[2].alias("service"), part[3].alias("subtree_hash"),
    )


def any_trace(edges: DataFrame, trace_ids: list[str]) -> DataFrame:
    """The edges of one of the given traces: the smallest (batch, trace id) that is there; no rows if none is."""
    there = edges.where(F.col("trace_id").isin(trace_ids))
    first = there.agg(F.min(F.struct("batch", "trace_id")).alias("m")).select("m.*")
    return there.join(first, ["batch", "trace_id"], "left_semi")


def to_blocks(spans: DataFrame) -> DataFrame:
    """One text block per trace, lines by span id."""
    line = F.concat_ws(":", F.coalesce("parent_span_id", F.lit("")), "span_id", "service", F.lit(""))
    return spans.groupBy("batch", "trace_id").agg(
        F.concat(F.lit(HEADER), F.col("trace_id"), F.lit(":\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_id", line.alias("l")))), lambda x: x["l"]), "\n"), F.lit("\n")).alias("value")
    )
