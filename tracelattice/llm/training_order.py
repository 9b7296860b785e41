"""Token sequences in training order, as fixed-stride binary shards.

1. Texts are encoded once and cut into sequences of ``length`` tokens, which are written as they come; a
   sequence's partition and place there, with the partitions' counts, give it a dense number.
2. A keyed Feistel network permutes [0, 4^h), the least such range that holds all numbers; results beyond
   the last number go through it again (cycle-walking), which leaves a permutation of the numbers: the
   global slots.
3. A shard holds ``rows`` consecutive slots in order.  A record is the tokens as little-endian uint16,
   filled up with 65535, and a line end: ``2 * length + 1`` bytes, so slot s is at byte
   ``s % rows * stride`` of shard ``s // rows``, and reading resumes anywhere.

Shards are written in ``waves``, each of a range of slots, so that only a part of the data is in shuffle
files at a time.  Rows are dealt by ranges of whole shards: a task has one shard, or several that together
hold ``TASK_BYTES`` at most, and sorts them with spill.  The sink is Spark's text writer, whose strings are raw
bytes, so shards go to any store that Spark writes.

Defined cases: null and empty texts have no sequence; a very long text has many, encoded in many tasks;
repeated rows are separate sequences; null keys are carried; other columns are left out; an empty table writes
nothing.  Ids from 65535 on are an error, since a record could not hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelattice import scratch
from tracelattice.llm import bpe
from tracelattice.llm.common import RID, ROW, dropping_shuffles, whole

LENGTH, ROWS, WAVES = 256, 16_384, 2
TASK_BYTES = 128 << 20  # of records that a task sorts and writes, where shards are smaller
FILL, END = 65535, "\n"
ROUNDS = 6


def mix(x: np.ndarray, key: int) -> np.ndarray:
    """A round function: two multiply-and-shift steps on 64 bits."""
    x = (x + np.uint64(key)) * np.uint64(0xD1342543DE82EF95)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xDA942042E4DD58B5)) >> np.uint64(20)


def slots(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The keyed permutation of [0, n) at ``numbers``."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.random.default_rng(key).integers(0, 1 << 62, ROUNDS).tolist()
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right, k) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def sequences(docs: DataFrame, rank_path: str, pattern: str, text: str, key: str, length: int) -> DataFrame:
    """(key, seq, n_tokens, tokens): the ids of each text in pieces of ``length``, cut where they are encoded."""
    plain = docs.select(F.struct(F.col(f"`{key}`").alias("key")).alias(ROW), whole(F.col(f"`{text}`")).alias("t"))

    def cut(rows: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        take, seq, size, raw = [], [], [], []
        for i, tokens in enumerate(ids):
            if len(tokens) and int(tokens.max()) >= FILL:
                raise ValueError(f"ids from {FILL} on do not fit a record")
            data = tokens.astype("<u2").tobytes()
            n = -(-len(tokens) // length)
            take += [i] * n
            seq += range(n)
            size += [length] * (n - 1) + [len(tokens) - length * (n - 1)] if n else []
            raw += [data[a : a + 2 * length] for a in range(0, len(data), 2 * length)]
        keys = rows.field("key") if isinstance(rows, pa.StructArray) else rows.combine_chunks().field("key")
        return pa.RecordBatch.from_arrays([keys.take(pa.array(take, pa.int64())), pa.array(seq, pa.int64()), pa.array(size, pa.int64()), pa.array(raw, pa.binary())], names=["key", "seq", "n_tokens", "tokens"])

    fields = [T.StructField("key", docs.schema[key].dataType), T.StructField("seq", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.BinaryType())]
    return bpe.encoded(plain, rank_path, pattern, cut, T.StructType(fields), library=True)


def materialise(
    docs: DataFrame, path: str, rank_path: str, pattern: str, seed: int = 0, text: str = "text", key: str = "doc_id",
    length: int = LENGTH, rows: int = ROWS, waves: int = WAVES,
) -> DataFrame:
    """Writes the shards below ``path``; returns (key, seq, n_tokens, slot, shard, offset) of every sequence."""
    spark = docs.sparkSession
    staged = scratch.materialise(sequences(docs, rank_path, pattern, text, key, length).withColumn(RID, F.monotonically_increasing_id()), "sequences")
    counted = sorted(map(tuple, staged.groupBy(F.shiftright(RID, 33).alias("p")).count().collect()))  # a row per partition
    before = np.concatenate(([0], np.cumsum([n for _, n in counted]))).astype(np.int64)
    total, known = int(before[-1]), spark.sparkContext.broadcast((np.array([p for p, _ in counted], np.int64), before))

    @F.pandas_udf(T.LongType())
    def slot_of(rid: pd.Series) -> pd.Series:
        names, starts = known.value
        r = rid.to_numpy()
        return pd.Series(slots(starts[np.searchsorted(names, r >> 33)] + (r & ((1 << 33) - 1)), total, seed))

    placed = staged.withColumn("slot", slot_of(RID)).withColumn("shard", F.call_function("div", F.col("slot"), F.lit(rows)))
    shards, stride = -(-total // rows), 2 * length + 1
    record = F.rpad("tokens", 2 * length, F.lit(b"\xff")).cast("string")
    with dropping_shuffles(spark):  # a wave's shuffle files go when it ends
        for w in range(min(waves, shards)):
            first, last = shards * w // waves if shards >= waves else w, shards * (w + 1) // waves if shards >= waves else w + 1
            part = placed.where((F.col("shard") >= first) & (F.col("shard") < last)).select("shard", "slot", record.alias("value"))
            # A range of whole shards for each task: enough tasks for all cores, at most TASK_BYTES each.
            each = max(1, min((last - first) // (2 * spark.sparkContext.defaultParallelism), TASK_BYTES // (rows * stride)))
            part = part.repartitionById(-(-(last - first) // each), F.call_function("div", F.col("shard") - first, F.lit(each)).cast("int"))
            part = part.sortWithinPartitions("shard", "slot")
            part.select("shard", "value").write.mode("append").partitionBy("shard").option("lineSep", END).text(path)
    offset = F.col("slot") % rows * stride
    return placed.select(F.col("key").alias(key), "seq", "n_tokens", "slot", "shard", offset.alias("offset"))


def read(spark: SparkSession, path: str, length: int = LENGTH, rows: int = ROWS, start: int = 0) -> DataFrame:
    """(slot, tokens) of all records from slot ``start`` on; earlier shards are not opened."""
    stride = 2 * length + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1)):
                data = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, stride)
                if (data[:, -1] != ord(END)).any():
                    raise ValueError(f"shard {shard} is not made of records of {stride} bytes")
                skip = max(0, start - shard * rows)
                for at in range(skip, len(data), 4096):
                    ids = np.ascontiguousarray(data[at : at + 4096, :-1]).view("<u2")
                    n = (ids != FILL).sum(axis=1)
                    flat, ends = ids[ids != FILL].astype(np.int32), np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(shard * rows + np.arange(at, at + len(ids))), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["slot", "tokens"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.withColumn("shard", F.col("shard").cast("long")).where(F.col("shard") >= start // rows)
    return files.select("shard", "content").mapInArrow(cut, "slot long, tokens array<int>")


def verified(placed: DataFrame, stored: DataFrame) -> DataFrame:
    """``placed`` with the columns of ``stored`` (slot, tokens); a slot that only one side has is an error."""
    both = placed.join(stored.withColumn("__stored", F.lit(True)), "slot", "full")
    lost = F.col("__stored").isNull() | F.col("shard").isNull()
    return both.withColumn("tokens", F.when(lost, F.raise_error(F.concat(F.lit("placed or stored only: slot "), "slot"))).otherwise(F.col("tokens"))).drop("__stored")
