"""Byte-level BPE over overlapping chunks.

Every text, short or long, is cut into chunks of ``CHUNK`` characters that reach ``OVERLAP`` characters into
the next one.  Chunks are pre-tokenised each by itself, then stitched: from a position where two neighbours
both start a pre-token both go on alike, since a match depends only on what follows.  Where neighbours share
no such position (a pre-token longer than the overlap), the scan goes on from the last sure start over twice
as many chunks each time.  The stitched pre-tokens are encoded, each by itself.  Decoding concatenates the raw
bytes of the ids.

A task takes a stretch of ``STRETCH`` chunks of one text at a time.  Texts of one stretch are encoded where
they are read; the stretches of longer ones are dealt to all tasks.  Each but the first begins with the last
chunk of the one before, which gives the position where it takes over; if the two ends agree all along a text,
its ids are those of the stretches in order.  If they do not (a pre-token longer than the overlap at that very
place), the text is stitched chunk by chunk in one task.

Defined cases: a null text is empty and has no ids; a very long text is many stretches, of which only the ids
come together in one row; every row is encoded, repeated or not, ties or null keys included; an empty table
gives no rows; an input column named like the output gives way to it.  The pattern must cover every character
and decide the end of a match by at most one character after it.  The rank file is a parameter; the driver
reads it and sends it to the executors (under 1 MB).
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelattice.llm.common import RID, ROW, pack, unpack, whole, without

CHUNK, OVERLAP, STRETCH = 2048, 128, 32  # characters, characters, chunks
PIECES_KEPT = 400_000  # pieces whose ids a worker remembers
BATCH = 256  # texts that are worked on at a time
IDS = T.ArrayType(T.IntegerType())

Finish = Callable[[pa.Array, list[np.ndarray]], pa.RecordBatch]


class Memory(dict):
    """Piece to its ids as little-endian int32 bytes."""

    def __init__(self, encoding: tiktoken.Encoding) -> None:
        self.encoding = encoding

    def __missing__(self, piece: str) -> bytes:
        if len(self) > PIECES_KEPT:
            self.clear()
        self[piece] = out = np.array(self.encoding.encode_ordinary(piece), np.int32).tobytes()
        return out


class Codec:
    def __init__(self, rank_file: bytes, pattern: str) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.pattern = regex.compile(pattern)
        self.memory = Memory(tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        self.known = np.zeros(max(ranks.values()) + 1, bool)
        self.known[list(ranks.values())] = True
        by_id = {i: b for b, i in ranks.items()}
        self.bytes_of = pa.array([by_id.get(i, b"") for i in range(len(self.known))], pa.large_binary())

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order."""
        out = self.pattern.findall(text)
        if sum(map(len, out)) != len(text):
            raise ValueError("the pattern leaves characters out")
        return out

    def ids(self, pieces: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memory.__getitem__, pieces)), np.int32)

    def stitched(self, text: str, size: int, overlap: int, leads: bool = False, own: int | None = None) -> tuple[list[str], int, int]:
        """(pre-tokens, begin, end) of a stretch of chunks; positions in ``text``, -1 if they are not sure.

        ``leads``: the first chunk belongs to the stretch before and only tells where this one takes over.
        ``own``: where the next stretch begins, if there is one.
        """
        bounds = [*range(size, len(text) if own is None else own, size), *([] if own is None else [own])]
        done: list[str] = []
        begin, at, reach, wide = 0, 0, min(size + overlap, len(text)), 1
        now = self.pieces(text[:reach])  # pre-tokens of text[at:reach]
        for base in bounds:
            context, last = leads and base == size, base == own
            if not last and (base + overlap < reach or (reach == len(text) and own is None)):
                continue  # within what was scanned from a sure start
            following = self.pieces(text[base : base + size + overlap])
            i, j, place = meet(now, reach, base, following)
            if place < 0:
                if context or last:
                    return [], -1, -1
                done += now[:-1]
                at, wide = reach - len(now[-1]), wide * 2
                reach = min(base + wide * size + overlap, len(text))
                now = self.pieces(text[at:reach])
                continue
            if context:
                begin = place
            else:
                done += now[:i]
            if last:
                return done, begin, place
            now, at, reach, wide = following[j:], place, min(base + size + overlap, len(text)), 1
        return done + now, begin, len(text)


def meet(now: list[str], reach: int, base: int, following: list[str]) -> tuple[int, int, int]:
    """The first place from ``base`` on where both lists start a pre-token: its index in either, and the
    place (-1 if there is none).  ``now`` ends at ``reach``, ``following`` starts at ``base``."""
    starts, place = {}, base
    for j, piece in enumerate(following):
        if place >= reach:
            break
        starts[place] = j
        place += len(piece)
    out, place = (-1, -1, -1), reach
    for i in range(len(now) - 1, -1, -1):
        place -= len(now[i])
        if place < base:
            break
        if place in starts:
            out = i, starts[place], place
    return out


@lru_cache(2)
def codec(rank_file: bytes, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def stretches(text: str, size: int, overlap: int, chunks: int) -> Iterator[tuple[str, int, int | None]]:
    """(characters, where they begin in ``text``, where the next stretch's own begin in them or None)."""
    step = size * chunks
    n = stretch_count(len(text), size, overlap, chunks)
    for u in range(n):
        first = u * step - (size if u else 0)
        last = u == n - 1
        yield text[first : len(text) if last else (u + 1) * step + overlap], first, None if last else (u + 1) * step - first


def stretch_count(length: int, size: int, overlap: int, chunks: int) -> int:
    """The last stretch is longer than the overlap."""
    return max(1, -(-(length - overlap) // (size * chunks)))


def arrays(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def as_ids(rows: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([rows, arrays(ids)], names=[ROW, "ids"])


def encoded(
    plain: DataFrame, rank_path: str, pattern: str, finish: Finish, schema: T.StructType,
    size: int = CHUNK, overlap: int = OVERLAP, chunks: int = STRETCH, library: bool = False,
) -> DataFrame:
    """``finish`` of the ids of ``plain`` (__row, t), in batches, in the tasks that have them.

    ``library``: texts of one stretch are left to the library's own call, for callers that need the ids and
    not the method; the ids are the same.
    """
    with open(rank_path, "rb") as f:
        ranks = plain.sparkSession.sparkContext.broadcast(f.read())
    row_type = plain.schema[ROW].dataType

    def encode_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value, pattern)
        one_call = lambda t: np.array(c.memory.encoding.encode_ordinary(t), np.int32)
        ids_of = one_call if library else lambda t: c.ids(c.stitched(t, size, overlap)[0])
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, BATCH):
                b = whole_batch.slice(at, BATCH)
                yield finish(b.column(0), [ids_of(t) for t in b.column(1).to_pylist()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.column(1).slice(i, 1)
                for u, (t, first, own) in enumerate(stretches(b.column(2)[i].as_py(), size, overlap, chunks)):
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(i, 1), row if u == 0 else pa.nulls(1, row.type), pa.array([u], pa.int32()), pa.array([first], pa.int32()), pa.array([own], pa.int32()), pa.array([t])],
                        names=[RID, ROW, "u", "first", "own", "t"],
                    )

    def encode_stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value, pattern)
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                _, _, u, first, own, t = (x[0].as_py() if k > 1 else None for k, x in enumerate(one.columns))
                pieces, begin, end = c.stitched(t, size, overlap, u > 0, own)
                places = [pa.array([first + x if x >= 0 else -1], pa.int32()) for x in (begin, end)]
                yield pa.RecordBatch.from_arrays([*one.columns, *places, arrays([c.ids(pieces)])], names=[RID, ROW, "u", "first", "own", "t", "begin", "end", "ids"])

    def join_up(group: pa.Table) -> pa.Table:
        group = group.sort_by("u").combine_chunks()
        begin, end = group["begin"].to_pylist(), group["end"].to_pylist()
        if -1 not in begin + end and begin[1:] == end[:-1]:
            ids = group["ids"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        else:
            c = codec(ranks.value, pattern)
            parts = zip(group["u"].to_pylist(), group["own"].to_pylist(), group["t"].to_pylist())
            ids = c.ids(c.stitched("".join(t[size if u else 0 : own] for u, own, t in parts), size, overlap)[0])
        return pa.Table.from_batches([finish(group[ROW].combine_chunks().slice(0, 1), [ids])])

    here = F.length("t") <= size * chunks + overlap
    one = plain.where(here).mapInArrow(encode_here, schema)
    many = plain.where(~here).select(F.monotonically_increasing_id().alias(RID), ROW, "t")
    cut_type = T.StructType([T.StructField(RID, T.LongType()), T.StructField(ROW, row_type), *[T.StructField(n, T.IntegerType()) for n in ("u", "first", "own")], T.StructField("t", T.StringType())])
    more = [T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("ids", IDS)]
    dealt = many.mapInArrow(cut, cut_type).repartition(RID, "u").mapInArrow(encode_stretch, T.StructType([*cut_type.fields, *more]))
    return one.unionByName(dealt.groupBy(RID).applyInArrow(join_up, schema))


def encode(
    docs: DataFrame, rank_path: str, pattern: str, text: str = "text", out: str = "ids", size: int = CHUNK, overlap: int = OVERLAP, chunks: int = STRETCH,
) -> DataFrame:
    """The other columns of ``docs`` and ``ids`` (array of int)."""
    names = without(docs, [text, out])
    plain = docs.select(F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in names]).alias(ROW), whole(F.col(f"`{text}`")).alias("t"))
    schema = T.StructType([plain.schema[ROW], T.StructField("ids", IDS)])
    return unpack(encoded(plain, rank_path, pattern, as_ids, schema, size, overlap, chunks), names, {out: F.col("ids")})


def joined_bytes(lists: pa.Array, bytes_of: pa.Array) -> pa.Array:
    """The bytes of each list's ids: the ids' bytes lie one after the other, so only their ends are picked."""
    flat = lists.flatten()  # without what a slice leaves out
    taken = bytes_of.take(flat)
    _, ends, data = taken.buffers()
    of_id = np.frombuffer(ends, np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    at = of_id[np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(at.astype(np.int64).tobytes()), data])


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes of the ids; null ids give no bytes, ids that the ranks lack are an error."""
    with open(rank_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    names = without(df, [out])
    source = df.select(F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias("i"), pack(df.select(*[F.col(f"`{c}`") for c in names])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value, pattern)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, BATCH):
                b = whole_batch.slice(at, BATCH)
                flat = b.column(0).flatten().to_numpy(zero_copy_only=False)
                if len(flat) and not (flat.min() >= 0 and flat.max() < len(c.known) and c.known[flat].all()):
                    raise ValueError("ids that the ranks lack")
                yield pa.RecordBatch.from_arrays([b.column(1), joined_bytes(b.column(0), c.bytes_of).cast(pa.binary())], names=[ROW, "decoded"])

    schema = T.StructType([T.StructField(ROW, source.schema[ROW].dataType), T.StructField("decoded", T.BinaryType())])
    return unpack(source.mapInArrow(run, schema), names, {out: F.col("decoded")})
