"""Structural classes: traces of one shape share a hash and are matched once."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelattice import scratch
from tracelattice.model import TracePattern
from tracelattice.operators.pattern import KEYS, match
from tracelattice.session import dropping_shuffles, ship

NO_SERVICE = "\x00"  # no service has this name
MOST = 200_000  # fixed value: spans of a trace that a task holds at a time; larger traces are hashed by joins
HASHED, OWN, LARGE = range(3)


def structure_hashes(spans: DataFrame, depth: int) -> DataFrame:
    """(structure_hash, batch, trace_id), a row per trace: an order-free hash of its labelled forest.

    A span's hash covers its service and its children's sorted hashes.  A trace's hash is that of its root,
    or covers the sorted hashes of all spans without a parent in the trace (orphans are such).  A trace that
    the hashes do not cover wholly is a class of its own, so it is matched by itself: deeper calls than
    ``depth`` levels, calls in a ring, a span id that occurs twice.
    """
    service = F.coalesce("service", F.lit(NO_SERVICE))
    nodes = spans.select(*KEYS, "span_id", "parent_span_id", service.alias("service"))
    known = nodes.select(*KEYS, F.col("span_id").alias("parent_span_id"), F.lit(True).alias("known")).distinct()
    nodes = nodes.join(known, [*KEYS, "parent_span_id"], "left").withColumn("top", F.col("known").isNull()).drop("known")
    hashed = nodes.withColumns({"h": F.md5(F.concat("service", F.lit("()"))), "n": F.lit(1).cast("bigint")})
    for _ in range(depth - 1):
        kids = (
            hashed.where(~F.col("top"))
            .groupBy(*KEYS, F.col("parent_span_id").alias("span_id"))
            .agg(F.array_join(F.array_sort(F.collect_list("h")), ",").alias("kids"), F.sum("n").alias("below"))
        )
        hashed = nodes.join(kids, [*KEYS, "span_id"], "left").select(
            nodes["*"], F.md5(F.concat("service", F.lit("("), F.coalesce("kids", F.lit("")), F.lit(")"))).alias("h"), (1 + F.coalesce("below", F.lit(0))).alias("n")
        )
    traces = hashed.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.when(F.col("top"), F.col("h")))).alias("tops"), F.sum(F.when(F.col("top"), F.col("n"))).alias("covered"),
        F.count("*").alias("spans"), F.array_size(F.collect_set("span_id")).alias("ids"),
    )
    whole = (F.coalesce("covered", F.lit(0)) == F.col("spans")) & (F.col("ids") == F.col("spans"))
    name = F.when(~whole, own_class()).when(F.size("tops") == 1, F.get("tops", 0)).otherwise(F.md5(F.concat(F.lit("+"), F.array_join("tops", ","))))
    return traces.select(name.alias("structure_hash"), *KEYS)


def own_class():
    """The class of a trace that stands alone."""
    return F.md5(F.concat(F.lit("trace:"), F.to_json(F.struct(*KEYS))))


@lru_cache(1 << 16)
def digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def hash_of(ids: list, parents: list, services: list, depth: int) -> str | None:
    """What ``structure_hashes`` says of one trace; None if the trace is a class of its own."""
    at = {x: i for i, x in enumerate(ids)}
    if len(at) < len(ids) or None in at:
        return None
    kids, tops = defaultdict(list), []
    for i, p in enumerate(parents):
        tops.append(i) if p is None or p not in at else kids[at[p]].append(i)
    order, level = list(tops), tops
    for _ in range(depth - 1):
        level = [j for i in level for j in kids.get(i, ())]
        order += level
    if len(order) < len(ids):
        return None
    hashes = [""] * len(ids)
    for i in reversed(order):
        below = ",".join(sorted([hashes[j] for j in kids[i]])) if i in kids else ""
        hashes[i] = digest(f"{NO_SERVICE if services[i] is None else services[i]}({below})")
    return hashes[tops[0]] if len(tops) == 1 else digest("+" + ",".join(sorted([hashes[i] for i in tops])))


def hashes_by_trace(spans: DataFrame, depth: int) -> DataFrame:
    """(batch, trace_id, structure_hash, state), the hashes of ``structure_hashes`` by one shuffle: a task reads
    trace after trace.  ``state`` tells traces of more than ``MOST`` spans, which have no hash here."""
    most = MOST
    ship(spans.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n = None, ([], [], []), 0

        def ended() -> tuple:
            h = hash_of(*held, depth) if n <= most else None
            return *key, h, LARGE if n > most else OWN if h is None else HASHED

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int32())], names=[*KEYS, "structure_hash", "state"])

        for b in batches:
            if not b.num_rows:
                continue
            batch, trace, *rest = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            starts = [0, *(((batch[1:] != batch[:-1]) | (trace[1:] != trace[:-1])).nonzero()[0] + 1).tolist(), b.num_rows]
            rest, out = [c.tolist() for c in rest], []
            for lo, hi in zip(starts, starts[1:]):
                here = (batch[lo], trace[lo])
                if here != key:
                    if key is not None:
                        out.append(ended())
                    key, held, n = here, ([], [], []), 0
                n += hi - lo
                if n <= most:
                    for whole, c in zip(held, rest):
                        whole += c[lo:hi]
                else:
                    held = ([], [], [])
            if out:
                yield packed(out)
        if key is not None:
            yield packed([ended()])

    rows = spans.select(*KEYS, "span_id", "parent_span_id", "service").repartition(*KEYS).sortWithinPartitions(*KEYS)
    return rows.mapInArrow(run, "batch string, trace_id string, structure_hash string, state int")


def class_table(parts: Iterable[DataFrame], depth: int) -> DataFrame:
    """The rows of ``structure_hashes``, written.  ``parts``: spans of whole traces, each trace in one part; the
    shuffle files of a part go before the next one begins, so more parts need less disk at a time."""
    tables = []
    for spans in parts:
        with dropping_shuffles(spans.sparkSession):
            found = scratch.materialise(hashes_by_trace(spans, depth), "classes")
            large = found.where(F.col("state") == LARGE).select(*KEYS)
            tables.append(found.where(F.col("state") != LARGE).select(F.coalesce("structure_hash", own_class()).alias("structure_hash"), *KEYS))
            if not large.isEmpty():
                tables.append(scratch.materialise(structure_hashes(spans.join(large, KEYS, "left_semi"), depth), "classes"))
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def exemplars(hashes: DataFrame) -> DataFrame:
    """The first trace of each class."""
    return hashes.groupBy("structure_hash").agg(F.min(F.struct(*KEYS)).alias("e")).select("structure_hash", "e.*")


def matching_classes(spans: DataFrame, hashes: DataFrame, p: TracePattern) -> DataFrame:
    """Classes whose exemplar holds the pattern."""
    first = exemplars(hashes)
    found = match(spans, p, anchor=spans.join(first.select(*KEYS), KEYS, "left_semi")).select(*KEYS).distinct()
    return first.join(found, KEYS, "left_semi").select("structure_hash")


def expand(hashes: DataFrame, classes: DataFrame) -> DataFrame:
    """All traces of the given classes."""
    return hashes.join(classes, "structure_hash", "left_semi").select(*KEYS)


def traces_by_class(spans: DataFrame, hashes: DataFrame, p: TracePattern) -> DataFrame:
    """Same rows as ``matching_traces``; pays where classes repeat."""
    return expand(hashes, matching_classes(spans, hashes, p))


def traces_without(spans: DataFrame, hashes: DataFrame, p: TracePattern) -> DataFrame:
    """All traces of the classes whose exemplar lacks the pattern."""
    return hashes.join(matching_classes(spans, hashes, p), "structure_hash", "left_anti").select(*KEYS)


def trace_text(spans: DataFrame) -> DataFrame:
    """(batch, trace_id, n_nodes, node_names, edges): each trace's structure in words, for a look at it."""
    name = F.concat_ws(" : ", "span_id", "service")
    edge = F.when(F.col("parent_span_id").isNotNull(), F.concat_ws(" : ", "parent_span_id", "span_id"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ", ")
    return spans.groupBy(*KEYS).agg(F.count("*").alias("n_nodes"), listed(name).alias("node_names"), listed(edge).alias("edges"))
