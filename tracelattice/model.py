"""Schemas and the small value objects that describe a search."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

ATTRIBUTES = T.ArrayType(T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("value", T.StringType()),
]))

SPAN_SCHEMA = T.StructType([
    T.StructField("batch", T.StringType()),
    T.StructField("trace_id", T.StringType()),
    T.StructField("span_id", T.StringType()),
    T.StructField("parent_span_id", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("start_ns", T.LongType()),
    T.StructField("end_ns", T.LongType()),
    T.StructField("attributes", ATTRIBUTES),
])

ANY_SERVICE = "NONE"  # fixed value: the label that matches every service


class Compare(Enum):
    EQ = "="
    LT = "<"
    GT = ">"


class IndexKind(Enum):
    BLOOM = "bloom"
    INVERTED = "inverted"
    RANGE = "range"
    NONE = "none"


@dataclass(frozen=True)
class TracePattern:
    """A labelled call graph: ``nodes[i]`` is the service of node i, ``edges`` go from caller to callee."""

    nodes: dict[int, str]
    edges: list[tuple[int, int]] = field(default_factory=list)

    def problems(self) -> list[str]:
        found = [] if self.nodes else ["the pattern has no node"]
        found += [f"edge {e} names an unknown node" for e in self.edges if not set(e) <= set(self.nodes)]
        return found + [f"edge {e} is a loop" for e in self.edges if e[0] == e[1]]

    def is_connected(self) -> bool:
        seen = {min(self.nodes)}
        while more := {y for a, b in self.edges for x, y in ((a, b), (b, a)) if x in seen} - seen:
            seen |= more
        return seen == set(self.nodes)


@dataclass(frozen=True)
class Condition:
    """``prop`` of the span bound to ``node`` compared with ``value``.

    ``prop`` is ``latency``, ``attr:<key>`` or a span column.
    """

    node: int
    prop: str
    compare: Compare
    value: object


@dataclass(frozen=True)
class Returning:
    """What a search yields: ``trace_id`` (distinct traces) or a property of one node (a bag)."""

    node: int = 0
    prop: str = "trace_id"


@dataclass(frozen=True)
class Window:
    """Inclusive epoch seconds."""

    start_s: int
    end_s: int
