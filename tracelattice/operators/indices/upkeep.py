"""Index updates: what came since the last one is built, written beside the rest, and the mark moves."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tracelattice import scratch
from tracelattice.functions.scalars import batch_bounds, floor_to
from tracelattice.model import IndexKind
from tracelattice.operators.indices import bloom, inverted, ranges
from tracelattice.operators.indices.catalog import Catalog, Entry
from tracelattice.operators.predicates import property_column

SCHEMAS = {IndexKind.INVERTED: inverted.SCHEMA, IndexKind.RANGE: ranges.SCHEMA, IndexKind.BLOOM: bloom.SCHEMA}
BLOOM = {"granularity": 86_400, "fan": 10, "levels": 3, "fpp": 1e-4}


def read(spans: DataFrame, e: Entry) -> DataFrame:
    """All runs of an index; ``run`` tells them apart."""
    return spans.sparkSession.read.schema(f"{SCHEMAS[e.kind]}, run string").parquet(e.path)


def most_values(spans: DataFrame, prop: str, granularity: int) -> int:
    """Distinct values of the fullest filter: one batch in one leaf."""
    at = floor_to(F.call_function("div", F.col("start_ns"), F.lit(1_000_000_000)), granularity)
    rows = spans.select(at.alias("leaf"), "batch", property_column(prop).cast("string").alias("v")).distinct().where("v is not null")
    return rows.groupBy("leaf", "batch").count().agg(F.max("count")).first()[0] or 1


def update(spans: DataFrame, catalog: Catalog, prop: str, kind: IndexKind, until: int, **params) -> Entry:
    """Brings the index of a property up to ``until``: batches that start after its mark and not after
    ``until`` are added as a run of their own, then the mark moves.  A run that fails leaves no entry, so the
    next one does its work again.  The first update makes the index; ``params`` of later ones are ignored.

    Batches whose name tells no time are never indexed; ``search`` reads them unpruned.
    """
    old = catalog.entry(prop, kind)
    spark, start = spans.sparkSession, batch_bounds(F.col("batch"))[0]
    new = spans.where(start <= until) if old is None else spans.where((start > old.last_updated) & (start <= until))
    if old is None:
        known = BLOOM | params if kind is IndexKind.BLOOM else params
        if kind is IndexKind.BLOOM and "n" not in known:
            known["n"] = max(1_000, 1 << (most_values(new, prop, known["granularity"]) - 1).bit_length())
        old = Entry(prop, kind, scratch.new_path(spark, f"index-{kind.value}"), known.get("granularity", 0), -1, known)
    elif until <= old.last_updated:
        return old
    k = old.params
    if kind is IndexKind.INVERTED:
        rows, save = inverted.layout(inverted.build(new, [prop.removeprefix("attr:")])), inverted.save
    elif kind is IndexKind.RANGE:
        rows, save = ranges.layout(ranges.build(new, prop, k.get("node_s", ranges.NODE_S))), ranges.save
    else:
        rows, save = bloom.build(new, prop, k["granularity"], k["fan"], k["levels"], k["n"], k["fpp"]), lambda df, path: df.write.parquet(path)
    save_checked(rows, save, f"{old.path}/run={uuid.uuid4().hex}", SCHEMAS[kind])
    entry = Entry(prop, kind, old.path, old.granularity, until, k)
    catalog.put(entry)
    return entry


def save_checked(rows: DataFrame, save: Callable[[DataFrame, str], None], path: str, schema: str) -> None:
    """Writes, reads back and compares number and digest of the rows."""
    names = [f.split()[0] for f in schema.split(", ")]
    digest = F.coalesce(F.bit_xor(F.xxhash64(*names)), F.lit(0))
    seen = Observation()
    save(rows.observe(seen, F.count(F.lit(1)).alias("n"), digest.alias("x")), path)
    back = rows.sparkSession.read.schema(schema).parquet(path).agg(F.count(F.lit(1)).alias("n"), digest.alias("x")).first()
    if (back["n"], back["x"]) != (seen.get["n"], seen.get["x"]):
        raise OSError(f"what was written to {path} reads back differently")
