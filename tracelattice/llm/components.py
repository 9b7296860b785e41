"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelattice import scratch


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every node of the links (a, b), longs; nodes of one component share a root.

    Each round, a node moves to the neighbour (or itself) that comes first in a new random order, and
    the links between the places that are left go on; their number falls by a constant factor.  The
    minimum is a partial aggregation, and both joins read written tables, so that the links of a hub are
    a skewed join that Spark splits.  Nulls are no nodes.
    """
    left = links.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    left = scratch.materialise(left, label)
    where = None
    number = 0
    while not left.isEmpty():
        number += 1
        pairs = left.select(F.explode(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u in "ab" for v in "ab"])).alias("x")).select("x.*")
        moves = pairs.groupBy("u").agg(F.min(F.struct(F.xxhash64(F.lit(number), "v").alias("rank"), "v")).alias("r")).select("u", F.col("r.v").alias("to"))
        moves = scratch.materialise(moves, label)
        if where is None:
            where = moves.select(F.col("u").alias("node"), F.col("to").alias("root"))
        else:
            old = where.withColumnRenamed("root", "u")
            where = scratch.materialise(old.join(moves, "u", "left").select("node", F.coalesce("to", "u").alias("root")), label)
        one = left.join(moves.withColumnsRenamed({"u": "a", "to": "x"}), "a").select("x", "b")
        two = one.join(moves.withColumnsRenamed({"u": "b", "to": "y"}), "b").where("x <> y")
        left = scratch.materialise(two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), label)
    if where is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return where
