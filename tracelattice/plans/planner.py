"""``search``: structure, conditions, indexes and projection in one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelattice.functions.scalars import batch_bounds
from tracelattice.model import ANY_SERVICE, Condition, IndexKind, Returning, TracePattern, Window
from tracelattice.operators import structure
from tracelattice.operators.batches import in_window, traces_in_window
from tracelattice.operators.indices import bloom, inverted, ranges, upkeep
from tracelattice.operators.indices.catalog import NUMBERS, Catalog, Entry, asked
from tracelattice.operators.pattern import KEYS, carried, match, matching_traces
from tracelattice.operators.predicates import property_column


def from_index(spans: DataFrame, e: Entry, c: Condition, w: Window | None) -> DataFrame:
    """Traces that one index names for one condition, in batches that overlap the window."""
    rows, value = upkeep.read(spans, e), asked(c)
    if e.kind is IndexKind.INVERTED:
        return inverted.probe(rows, c.prop.removeprefix("attr:"), value, w)
    if e.kind is IndexKind.RANGE:
        # A bound span may start outside the window that its trace's root overlaps: only batches are pruned.
        return ranges.probe(in_window(rows, w), c.prop, c.compare, value, lexical=c.prop not in NUMBERS)
    k = e.params
    return bloom.verify(spans, in_window(bloom.probe(rows, value, k["levels"], n=k["n"], fpp=k["fpp"]), w), c.prop, value)


def prune(rows: DataFrame, found: list[tuple[DataFrame, Entry]]) -> DataFrame:
    """Rows of traces that every index names, in one join.  Indexes only prune: batches that start after an
    index was updated, or whose name tells no time, pass that index unpruned."""
    named = None
    for k, (traces, _) in enumerate(found):
        one = traces.select(*KEYS).distinct().withColumn("bit", F.lit(1 << k).cast("bigint"))
        named = one if named is None else named.unionByName(one)
    named = named.groupBy(*KEYS).agg(F.bit_or("bit").alias("__named"))
    start = batch_bounds(F.col("batch"))[0]
    passes = F.coalesce("__named", F.lit(0).cast("bigint"))
    for k, (_, e) in enumerate(found):
        passes = passes.bitwiseOR(F.when(F.coalesce(start > e.last_updated, F.lit(True)), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint"))
    return rows.join(named, KEYS, "left").where(passes == (1 << len(found)) - 1).drop("__named")


def label_counts(spans: DataFrame, p: TracePattern) -> dict[str, int]:
    """Spans of each label of the pattern, for ``search``; at most a row per label comes to the driver."""
    rows = spans.where(F.col("service").isin([s for s in p.nodes.values() if s != ANY_SERVICE])).groupBy("service").count().collect()
    return {s: 0 for s in p.nodes.values()} | {r["service"]: r["count"] for r in rows}


def search(
    spans: DataFrame,
    p: TracePattern,
    w: Window | None = None,
    conditions: list[Condition] | None = None,
    returning: Returning | None = None,
    binding: str = "span",
    catalog: Catalog | None = None,
    hashes: DataFrame | None = None,
    counts: dict[str, int] | None = None,
) -> DataFrame:
    """Traces that contain ``p`` within ``w`` and satisfy every condition on one mapping.

    Returns distinct (batch, trace_id), or one row per mapping with the asked property (column ``value``; a
    text that is missing is '').  A window that ends before it starts, or a pattern with problems, gives no
    rows; with a window, so do batches whose name tells no time.  ``hashes``: class table for matching each
    shape once; ``catalog``: indexes to prune with; ``counts``: spans of each label, to begin with the rarest
    (else the pattern's order).  None of these changes the result.
    """
    conditions, returning = conditions or [], returning or Returning()
    if p.problems() or (w is not None and w.end_s < w.start_s):
        none = spans.limit(0)
        return none.select(*KEYS) if returning.prop == "trace_id" else none.select(*KEYS, value_of(spans, property_column(returning.prop)).alias("value"))
    rows = anchor = in_window(spans, w)
    if w is not None:
        anchor = anchor.join(traces_in_window(spans, w), KEYS, "left_semi")
    if hashes is not None:
        # What has a class that lacks the pattern goes; so traces without a class stay, and no other span is read.
        anchor = anchor.join(structure.traces_without(rows, in_window(hashes, w), p), KEYS, "left_anti")
    entries = catalog.entries() if catalog is not None else []
    found = [(from_index(spans, e, c, w), e) for c in conditions if catalog is not None and (e := catalog.find(c, entries))]
    if found:
        anchor = prune(anchor, found)
    if returning.prop == "trace_id":
        return matching_traces(rows, p, conditions, anchor, binding=binding, counts=counts)
    hit = match(rows, p, conditions, {returning.node: [returning.prop]}, binding, counts, anchor=anchor)
    return hit.select(*KEYS, value_of(hit, F.col(carried(returning.node, returning.prop))).alias("value"))


def value_of(df: DataFrame, column: Column) -> Column:
    """A returned property: '' for a text that is missing."""
    return F.coalesce(column, F.lit("")) if df.select(column.alias("v")).schema["v"].dataType.simpleString() == "string" else column
