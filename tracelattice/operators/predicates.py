"""Conditions compiled to one boolean Column each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelattice.functions.scalars import attribute, latency, literal_text, seconds
from tracelattice.model import Compare, Condition

OPS = {Compare.EQ: lambda a, b: a == b, Compare.LT: lambda a, b: a < b, Compare.GT: lambda a, b: a > b}


def property_column(prop: str) -> Column:
    """A span property: ``latency``, ``start_s``, ``end_s``, ``attr:<key>`` or a column."""
    if prop == "latency":
        return latency(F.col("start_ns"), F.col("end_ns"))
    if prop in ("start_s", "end_s"):
        return seconds(F.col(prop.replace("_s", "_ns")))
    if prop.startswith("attr:"):
        return attribute(prop[5:])
    return F.col(prop)


def predicate(c: Condition) -> Column:
    """True where the condition holds; a missing value never satisfies it.

    Attributes compare as UTF-8 text, in the form of ``as_text``; everything else in its own type's order.
    """
    value = literal_text(c.value) if c.prop.startswith("attr:") else c.value
    return F.coalesce(OPS[c.compare](property_column(c.prop), F.lit(value)), F.lit(False))


def value_predicate(column: Column, compare: Compare, value: str) -> Column:
    """Textual comparison, as the value indexes use it."""
    return F.coalesce(OPS[compare](column, F.lit(value)), F.lit(False))


def all_of(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & predicate(c)
    return out
