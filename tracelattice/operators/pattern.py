"""Pattern graphs compiled to joins.

One projection of ``spans`` per node, filtered before joining; one equi-join per edge on
(batch, trace_id, span id).  Nodes are placed so that each new one has an edge to an earlier one.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelattice.model import ANY_SERVICE, Condition, TracePattern
from tracelattice.operators.predicates import all_of, predicate, property_column

KEYS = ["batch", "trace_id"]


def carried(node: int, prop: str) -> str:
    """Name of a node's property in the result of ``match``."""
    return f"n{node}_{prop.replace(':', '_').replace('.', '_')}"


def placement(p: TracePattern, counts: dict[str, int] | None = None) -> list[int]:
    """Rarest label first, then always a neighbour of a placed node while there is one."""
    weight = lambda i: ((counts or {}).get(p.nodes[i], 0 if counts else 1) if p.nodes[i] != ANY_SERVICE else float("inf"), i)
    order: list[int] = []
    while len(order) < len(p.nodes):
        near = {b if a in order else a for a, b in p.edges if (a in order) != (b in order)}
        order.append(min(near or set(p.nodes) - set(order), key=weight))
    return order


def node_rows(spans: DataFrame, p: TracePattern, i: int, conditions: list[Condition], carry: list[str]) -> DataFrame:
    """Candidates of one node: label and conditions are applied here, so they reach the scan."""
    rows = spans if p.nodes[i] == ANY_SERVICE else spans.where(F.col("service") == p.nodes[i])
    own = [c for c in conditions if c.node == i]
    rows = rows.where(all_of(own)) if own else rows
    extra = [property_column(prop).alias(carried(i, prop)) for prop in carry if prop not in ("span_id", "service")]
    return rows.select(*KEYS, F.col("span_id").alias(f"n{i}_span_id"), F.col("parent_span_id").alias(f"n{i}_parent"), F.col("service").alias(f"n{i}_service"), *extra)


def match(
    spans: DataFrame,
    p: TracePattern,
    conditions: list[Condition] | None = None,
    carry: dict[int, list[str]] | None = None,
    binding: str = "span",
    counts: dict[str, int] | None = None,
    induced: bool = True,
    anchor: DataFrame | None = None,
) -> DataFrame:
    """One row per mapping of pattern nodes to spans: batch, trace_id, n{i}_span_id and carried columns.

    Distinct nodes map to distinct spans.  ``binding='span'`` tests a condition on the bound span;
    ``'service'`` asks for any span of the same service in the trace.  ``induced`` forbids calls
    between mapped spans that the pattern lacks; on trees that matters only for unconnected patterns.
    ``anchor``: the rows of ``spans`` in traces that count; only the first node is taken from it, since all
    others join to that one, so what restricts the traces is in the plan once.
    """
    if p.problems():
        raise ValueError("; ".join(p.problems()))
    conditions, carry = conditions or [], carry or {}
    on_span = conditions if binding == "span" else []
    order = placement(p, counts)
    out = node_rows(spans if anchor is None else anchor, p, order[0], on_span, carry.get(order[0], []))
    placed = [order[0]]
    for i in order[1:]:
        rows = node_rows(spans, p, i, on_span, carry.get(i, []))
        for k in KEYS:
            rows = rows.withColumnRenamed(k, f"__{k}")
        on = [F.col(k) == F.col(f"__{k}") for k in KEYS]
        for a, b in p.edges:
            if b == i and a in placed:
                on.append(F.col(f"n{a}_span_id") == F.col(f"n{i}_parent"))
            elif a == i and b in placed:
                on.append(F.col(f"n{i}_span_id") == F.col(f"n{b}_parent"))
        for j in placed:
            if p.nodes[i] == p.nodes[j] or ANY_SERVICE in (p.nodes[i], p.nodes[j]):
                on.append(F.col(f"n{i}_span_id") != F.col(f"n{j}_span_id"))
        out = out.join(rows, on, "inner").drop(*(f"__{k}" for k in KEYS))
        placed.append(i)
    if induced and not p.is_connected():
        for a, b in combinations(sorted(p.nodes), 2):
            for x, y in ((a, b), (b, a)):
                if (x, y) not in p.edges:
                    out = out.where(~F.col(f"n{y}_parent").eqNullSafe(F.col(f"n{x}_span_id")))
    if binding == "service":
        for c in conditions:
            holds = spans.where(predicate(c)).select(*KEYS, F.col("service").alias(f"n{c.node}_service")).distinct()
            out = out.join(holds, [*KEYS, f"n{c.node}_service"], "left_semi")
    names = [carried(i, x) for i in sorted(p.nodes) for x in ("span_id", "service", *carry.get(i, []))]
    return out.select(*KEYS, *dict.fromkeys(names))


def matching_traces(spans: DataFrame, p: TracePattern, conditions: list[Condition] | None = None, anchor: DataFrame | None = None, **how) -> DataFrame:
    """Distinct (batch, trace_id).  A star of leaf siblings without conditions is answered by counting
    children per label instead of enumerating their permutations."""
    star = star_shape(p)
    if star and not conditions:
        root, need = star
        kids = spans.where(F.col("service").isin(list(need))).groupBy(*KEYS, F.col("parent_span_id").alias("n0")).agg(
            *[at_least(F.when(F.col("service") == s, F.col("span_id")), n).alias(f"k{j}") for j, (s, n) in enumerate(need.items())]
        )
        for j in range(len(need)):
            kids = kids.where(f"k{j}")
        tops = (spans if anchor is None else anchor).where(F.col("service") == root).select(*KEYS, F.col("span_id").alias("n0"))
        return tops.join(kids, [*KEYS, "n0"], "left_semi").select(*KEYS).distinct()
    return match(spans, p, conditions, anchor=anchor, **how).select(*KEYS).distinct()


def at_least(ids: Column, n: int) -> Column:
    """Aggregate: are there ``n`` different ids?  Up to two are told by 64-bit hashes in fixed-size buffers."""
    if n == 1:
        return F.count(ids) > 0
    h = F.when(ids.isNotNull(), F.xxhash64(ids))
    return F.coalesce(F.min(h) != F.max(h), F.lit(False)) if n == 2 else F.array_size(F.collect_set(ids)) >= n


def star_shape(p: TracePattern) -> tuple[str, dict[str, int]] | None:
    """(root label, children per label) if every edge leaves one root and no label is a wildcard."""
    tops = {a for a, _ in p.edges}
    if len(tops) != 1 or len(p.edges) != len(p.nodes) - 1 or ANY_SERVICE in p.nodes.values():
        return None
    root = next(iter(tops))
    if len({b for _, b in p.edges}) != len(p.edges):
        return None
    need: dict[str, int] = {}
    for _, b in p.edges:
        need[p.nodes[b]] = need.get(p.nodes[b], 0) + 1
    return p.nodes[root], need
