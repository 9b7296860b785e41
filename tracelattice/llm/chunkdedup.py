"""Repeated passages by content-defined chunking.

A gear hash rolls over the bytes of each text; a chunk ends where the top bits of the hash's 16-byte
window are zero, so an insertion moves only the boundaries near it.  Chunks have at least ``LEAST`` bytes
(a boundary sooner is passed over) and at most ``MOST``, and end between characters.  They are known by
64-bit digests; a passage counts as repeated only if consecutive chunks that other documents have too
hold ``MIN_WORDS`` words or more, so neither short phrases nor a chance digest are enough.

Plan: one pass writes each document's digests as arrays.  A digest's number of documents is a partial
aggregation of one row per document and digest; the digests of two documents or more are written and
joined back, and a passage of a third of all rows is a skewed join that Spark splits.  Runs are made per
document.

Defined cases: null texts are empty and have no chunks; every row is a document, so repeated rows repeat
each other, the row read first being the first; a very long text is one row of its task while it is cut, and
its chunks are dealt from then on; null keys are carried; other columns are left out; an empty table gives no
rows.  A passage that only one document has, however often, is not reported, nor are texts of fewer words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelattice import scratch
from tracelattice.llm.common import RID, whole

LEAST, MOST, BITS = 16, 256, 4
MIN_WORDS = 25
GEAR = np.random.default_rng(20240101).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a text's bytes."""
    n = len(data)
    if not n:
        return []
    b = np.frombuffer(data, np.uint8)
    h = GEAR[b]
    for k in (1, 2, 4, 8):  # after each step the hash covers twice as many bytes
        h[k:] = h[k:] + (h[:-k] << np.uint32(k)) if len(h) > k else h[k:]
    # 16 bytes are in; the top BITS of its low 16 bits depend on nearly all of them.
    mark = (h >> np.uint32(16 - BITS)) & np.uint32((1 << BITS) - 1) == 0
    inside = (b & 0xC0) == 0x80  # continuation bytes: no cut before them
    mark[:-1] &= ~inside[1:]
    out, last = [], 0
    for e in (np.flatnonzero(mark) + 1).tolist():
        while e - last > MOST:
            last = forced(inside, last)
            out.append(last)
        if e - last >= LEAST:
            out.append(e)
            last = e
    while n - last > MOST:
        last = forced(inside, last)
        out.append(last)
    return out + [n] if last < n else out


def forced(inside: np.ndarray, last: int) -> int:
    """A cut after ``MOST`` bytes or just before, between characters."""
    e = last + MOST
    while inside[e]:
        e -= 1
    return e


def chunked(rows: DataFrame) -> DataFrame:
    """(__rid, key, digests, ends, words, again) of (__rid, key, text): one row per document; ``ends`` in
    characters, ``words`` that begin in each chunk, ``again``: the document had the chunk before."""
    key_type = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 256):
                batch = whole_batch.slice(at, 256)
                digests, ends, words, again = [], [], [], []
                for t in batch.column(2):
                    data = t.as_py().encode("utf-8", "surrogatepass")
                    e = cuts(data)
                    s = [0, *e[:-1]]
                    named = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(s, e)]
                    digests.append(named)
                    seen = np.ones(len(named), bool)
                    seen[list({d: k for k, d in zip(range(len(named) - 1, -1, -1), reversed(named))}.values())] = False
                    again.append(seen)
                    b = np.frombuffer(data, np.uint8)
                    space = (b == 32) | ((b >= 9) & (b <= 13))
                    begins = np.concatenate(([0], np.cumsum(~space & np.concatenate(([True], space[:-1])) if len(b) else [])))
                    chars = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))
                    ends.append(chars[e].astype(np.int32) if e else np.zeros(0, np.int32))
                    words.append((begins[e] - begins[s]).astype(np.int32) if e else np.zeros(0, np.int32))
                signed = [np.array(d, np.uint64).view(np.int64) for d in digests]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signed, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.int32())), pa.array(again, pa.list_(pa.bool_()))], names=[RID, "key", "digests", "ends", "words", "again"])

    return rows.select(RID, "key", whole("text")).mapInArrow(run, f"{RID} long, key {key_type}, digests array<long>, ends array<int>, words array<int>, again array<boolean>")


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, start, end, n_words, n_docs, is_first): passages that another document has too.

    A run of such chunks counts if it holds ``min_words``; it is cut where ``is_first`` changes: whether its
    chunks are the first of their kind (in the earliest row, and there at the first place).  Without the
    passages that are not first, so, each chunk stays at exactly one place.  ``n_docs``: documents that share
    the passage's rarest chunk.
    """
    rows = docs.select(F.monotonically_increasing_id().alias(RID), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    named = scratch.materialise(chunked(rows), "chunks")
    each = named.select(RID, F.explode(F.array_distinct("digests")).alias("d"))
    shared = each.groupBy("d").agg(F.count("*").alias("n_docs"), F.min(RID).alias("owner")).where("n_docs > 1")
    shared = scratch.materialise(shared, "shared")
    chunk = F.arrays_zip("digests", "ends", "words", "again")
    parts = named.select(RID, F.posexplode(chunk).alias("k", "c"), "ends").select(
        RID, "k", F.col("c.digests").alias("d"), F.coalesce(F.get("ends", F.col("k") - 1), F.lit(0)).alias("start"), F.col("c.ends").alias("end"), F.col("c.words").alias("w"), F.col("c.again").alias("again")
    )
    hits = parts.join(shared, "d").withColumn("is_first", (F.col("owner") == F.col(RID)) & ~F.col("again")).drop("d", "owner", "again")
    number = lambda *by: F.row_number().over(Window.partitionBy(RID, *by).orderBy("k"))
    hits = hits.withColumn("run", F.col("k") - number())
    # Per run: its words, and its stretches of one kind (consecutive places less a count of the kind).
    stretch = hits.withColumn("part", F.col("k") - number("is_first")).groupBy(RID, "run", "is_first", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("w").alias("n_words"), F.min("n_docs").alias("n_docs")
    )
    in_run = F.sum("n_words").over(Window.partitionBy(RID, "run"))
    found = stretch.withColumn("in_run", in_run).where(F.col("in_run") >= min_words)
    return found.join(named.select(RID, "key"), RID).select(F.col("key").alias(key), "start", "end", "n_words", "n_docs", "is_first")
