"""What is indexed, how, and up to which second: one small table."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelattice import scratch
from tracelattice.functions.scalars import literal_text
from tracelattice.model import Compare, Condition, IndexKind

SCHEMA = "prop string, kind string, path string, granularity bigint, last_updated bigint, params string, version bigint"
NUMBERS = ("latency", "start_ns", "end_ns", "start_s", "end_s")  # properties that are whole numbers

TEXTS = ("trace_id", "span_id", "parent_span_id", "service", "name")


@dataclass(frozen=True)
class Entry:
    """An index of all batches that start no later than ``last_updated``; ``params``: what it was built with."""

    prop: str
    kind: IndexKind
    path: str
    granularity: int
    last_updated: int
    params: dict = field(default_factory=dict)


def asked(c: Condition) -> str | None:
    """The text of the condition's value as indexes hold it; None if no index can answer the condition."""
    if c.prop.startswith("attr:"):
        return literal_text(c.value)
    if c.prop in NUMBERS:
        try:
            value = Decimal(str(c.value))
        except InvalidOperation:
            return None
        fits = value.is_finite() and abs(value) < 10**28 and value == round(value, 9)
        return None if isinstance(c.value, bool) or not fits else str(int(value)) if value == int(value) else str(value)
    return c.value if c.prop in TEXTS and isinstance(c.value, str) else None


class Catalog:
    """Append-only: the row with the highest version of a (prop, kind) counts."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch.new_path(spark, "catalog")

    def put(self, e: Entry) -> None:
        version = 1 + max((r["version"] for r in self._rows()), default=0)
        row = [(e.prop, e.kind.value, e.path, e.granularity, e.last_updated, json.dumps(e.params), version)]
        self.spark.createDataFrame(row, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def _rows(self) -> list:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return []
        return self.spark.read.schema(SCHEMA).parquet(self.path).collect()  # one row per index update

    def entries(self) -> list[Entry]:
        newest: dict = {}
        for r in sorted(self._rows(), key=lambda r: r["version"]):
            newest[r["prop"], r["kind"]] = Entry(r["prop"], IndexKind(r["kind"]), r["path"], r["granularity"], r["last_updated"], json.loads(r["params"] or "{}"))
        return list(newest.values())

    def entry(self, prop: str, kind: IndexKind) -> Entry | None:
        return next((e for e in self.entries() if (e.prop, e.kind) == (prop, kind)), None)

    def earliest(self) -> int | None:
        """Up to which second all indexes are made."""
        return min((e.last_updated for e in self.entries()), default=None)

    def find(self, c: Condition, entries: list[Entry] | None = None) -> Entry | None:
        """The index that can answer a condition: inverted takes equality of attributes, bloom equality,
        range any comparison.  ``entries``: those of this catalog, if they are read already."""
        if asked(c) is None:
            return None
        able = lambda e: e.kind is IndexKind.RANGE or c.compare is Compare.EQ and (e.kind is IndexKind.BLOOM or c.prop.startswith("attr:"))
        fits = [e for e in (self.entries() if entries is None else entries) if e.prop == c.prop and able(e)]
        rank = [IndexKind.INVERTED, IndexKind.RANGE, IndexKind.BLOOM]
        return min(fits, key=lambda e: rank.index(e.kind), default=None)


def intersect(parts: list[DataFrame]) -> DataFrame:
    """(batch, trace_id) in every part."""
    tagged = [p.select("batch", "trace_id").distinct() for p in parts]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.groupBy("batch", "trace_id").agg(F.count("*").alias("n")).where(F.col("n") == len(parts)).drop("n")
