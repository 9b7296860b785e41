"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Rows are written once; a row's partition and place there are then fixed, also for tasks that are
   repeated.
2. Entry (p, b) of the matrix says how many rows partition p sends to bucket b.  Given the partitions'
   counts and the buckets' sizes, a uniform permutation makes it multivariate hypergeometric.  The matrix
   is never held: it is drawn by halving the partitions, each half's column sums from a generator seeded
   by that half, so every task draws just its own row in log(partitions) steps.
3. Within a partition a random permutation says which rows go where (permute locally), then rows are
   exchanged by bucket, and each bucket is put in random order (permute again).

Shards have equal sizes but for one row, and are made of buckets of at most ``BUCKET_ROWS`` rows and, on
average, ``BUCKET_BYTES`` bytes of text and binary columns, so no task ever holds a large shard; a bucket is
sorted with spill.  The driver holds one count per partition.

Defined cases: null texts and ids are carried as they are; a very long text is one row of its bucket; repeated
rows are separate rows; shards may be empty if there are fewer rows than shards; an empty table gives no rows;
input columns named like an output give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelattice import scratch
from tracelattice.llm.common import RID, ROW, pack, unpack

BUCKET_ROWS, BUCKET_BYTES = 16_384, 64 << 20
LIMIT = 10**9  # fixed value: numpy draws from populations below this


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n drawn are good; beyond numpy's limit by inversion over 14 deviations round the mode."""
    if good + bad < LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    sd = (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5
    mode = (n + 1) * (good + 1) // (total + 2)
    lo, hi = max(0, n - bad, mode - int(14 * sd) - 2), min(n, good, mode + int(14 * sd) + 2)
    k = np.arange(lo, hi, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    weights = np.cumsum(np.exp(logs - logs.max()))
    return lo + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def multivariate(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """How many of n drawn without replacement come from each class."""
    if sizes.sum() < LIMIT:
        return rng.multivariate_hypergeometric(sizes, n, method="marginals") if len(sizes) else sizes
    out, rest = np.zeros_like(sizes), int(sizes.sum())
    for i, size in enumerate(sizes.tolist()):
        rest -= size
        out[i] = hypergeometric(rng, size, rest, n)
        n -= int(out[i])
    return out


def matrix_row(seed: int, before: np.ndarray, sizes: np.ndarray, p: int) -> np.ndarray:
    """Row p of the matrix; ``before``: rows before each partition, and in all."""
    lo, hi, columns = 0, len(before) - 1, sizes
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = multivariate(np.random.default_rng([seed, 0, lo, hi]), columns, int(before[mid] - before[lo]))
        lo, hi, columns = (lo, mid, left) if p < mid else (mid, hi, columns - left)
    return columns


def bucket_sizes(rows: int, shards: int, per_shard: int) -> np.ndarray:
    """Sizes of the buckets, shard by shard."""
    size = np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)
    cuts = size[:, None] * np.arange(per_shard + 1)[None, :] // per_shard
    return np.diff(cuts, axis=1).reshape(-1)


def buckets_per_shard(rows: int, size: int, shards: int, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> int:
    """So that no bucket has more than these rows, and the mean bucket not more than these bytes."""
    return max(1, -(-(-(-rows // shards)) // bucket_rows), -(-size // (shards * bucket_bytes)))


def shuffle(docs: DataFrame, shards: int, seed: int = 0, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard)."""
    staged = scratch.materialise(docs.select(pack(docs), F.monotonically_increasing_id().alias(RID)), "staged")
    source, place = F.shiftright(RID, 33), F.col(RID).bitwiseAND(F.lit((1 << 33) - 1))
    large = [f.name for f in docs.schema.fields if f.dataType.typeName() in ("string", "binary")]
    size = sum((F.coalesce(F.octet_length(F.col(f"{ROW}.`{c}`")), F.lit(0)).cast("bigint") for c in large), F.lit(0).cast("bigint"))
    counted = sorted(map(tuple, staged.groupBy(source.alias("p")).agg(F.count("*"), F.sum(size)).collect()))  # one row per partition
    before = np.concatenate(([0], np.cumsum([n for _, n, _ in counted]))).astype(np.int64)
    rows = int(before[-1])
    per_shard = buckets_per_shard(rows, sum(b for *_, b in counted), shards, bucket_rows, bucket_bytes)
    sizes = bucket_sizes(rows, shards, per_shard)

    known = docs.sparkSession.sparkContext.broadcast((np.array([p for p, *_ in counted], np.int64), before, sizes))  # a number per partition and bucket

    @F.pandas_udf("int")
    def bucket_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names, before, sizes = known.value
        last, order, ends = None, None, None
        for p, at in batches:
            out = np.zeros(len(p), np.int32)
            for one in p.unique().tolist():
                if one != last:
                    k = int(np.searchsorted(names, one))
                    order = np.random.default_rng([seed, 1, k]).permutation(int(before[k + 1] - before[k]))
                    last, ends = one, np.cumsum(matrix_row(seed, before, sizes, k))
                mine = (p == one).to_numpy()
                out[mine] = np.searchsorted(ends, order[at[mine].to_numpy()], side="right")
            yield pd.Series(out)

    dealt = staged.withColumn("b", bucket_of(source, place))
    again = Window.partitionBy("b").orderBy(F.xxhash64(F.lit(seed), RID), RID)
    dealt = dealt.withColumn("turn", F.row_number().over(again) - 1)
    shard = F.call_function("div", F.col("b"), F.lit(per_shard)).cast("int")
    size = F.lit(rows // shards).cast("bigint") + F.when(shard < rows % shards, 1).otherwise(0)
    start = F.call_function("div", F.col("b").cast("bigint") % per_shard * size, F.lit(per_shard))
    return unpack(dealt, docs.columns, {"shard": shard, "slot": start + F.col("turn")})
