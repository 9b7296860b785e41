"""SimHash near-duplicates by anchor-point covering.

Fingerprints: 64 bits, each set if it is set in over half the XXH64 hashes of a text's 4-word shingles.
Links: fingerprints that differ in at most 4 bits.

Covering: the 64 bits are cut into 3 bands, so fingerprints that differ in up to 5 bits differ in at most 1 bit
of some band.
In each band the anchors are a covering code: a Hamming code of length 15 on the band's first bits, times
all values of the rest.  Every band value is within 1 bit (the covering radius) of its home anchor; a
fingerprint is copied to every anchor within the radius plus 1 that can be the home of a value 1 bit away
(8 to 15 of them).  Linked fingerprints so meet at the home anchor of either; there they are compared over
all 64 bits.

Equal fingerprints are collapsed first, so copies cost one row.  Each task passes on only a spanning
forest of the links that it finds, never all pairs of a group.  Anchors with many rows (a large group of
near copies) are split: both homes and copies are dealt to blocks of at most ``BLOCK``, and a cell is a block of
the one by a block of the other.  The table of such anchors has at most 2^19 rows: there are no more anchors in
the narrow cover, and in the wide one ``BLOCK`` grows with the rows, so that no more can be heavy.

Near copies by similarity (``similar``) need more than 5 of 64 bits: two texts that share 0.8 of their shingles
differ in 15 % of all bits.  There a fingerprint has 256 bits, of the distinct five-word shingles, and links at
``WIDE_DISTANCE``.  A band is 23 bits, its anchors the perfect Golay code of covering radius 3, and a fingerprint
is copied to the anchors within that radius plus 1 (5.3 on average).  Of pairs at a similarity of 0.8, 0.39 meet in
a band, so 8 bands leave out 2 %.  Beyond ``CROWD`` distinct fingerprints each band takes more bits that must be
equal, one for every doubling, and ``bands`` adds as many bands as keep that share.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelattice import scratch
from tracelattice.llm.common import RID, without
from tracelattice.llm.components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4  # fixed values
BANDS = ((0, 21), (21, 21), (42, 22))  # first bit and width
MOST_DISTANCE = 2 * len(BANDS) - 1  # of so many differing bits one band has at most one
CODE = 15  # length of the Hamming code, of 11 data bits
BLOCK = 20_000  # rows of an anchor from which it is split
DENSE = 48  # members from which a cell is walked instead of compared pairwise
CHUNK = 1 << 20
SINGLE = 8192  # members of a dense cell up to which those without any neighbour are found first

WIDE_SHINGLE, WIDE_WORDS = 5, 4  # words of a shingle; 64-bit words of a fingerprint
WIDE_DISTANCE = 46  # of 256 bits; a similarity of 0.8 differs in 39 on average, with a deviation of 5.7
GOLAY, GOLAY_POLYNOMIAL = 23, 0xAE3  # fixed values: length and generator of the perfect Golay code
RADIUS, MARGIN = 3, 1  # covering radius of that code, and the threshold of a band
MEET, DIFFER = 0.394, 0.1514  # of pairs at a similarity of 0.8: those that meet in a band, and the bits that differ
MISSED = 0.02  # share of such pairs that may meet in no band
CROWD = 1 << 22
MOST_HEAVY = 1 << 19  # anchors in the table of splits


def shingle_hashes(text: str | None, n: int) -> Iterator[bytes]:
    """XXH64 of the shingles of ``n`` words, 8 bytes each, in parts of bounded size; nothing without a word."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(1, len(w) - n + 1)
    last = ends[n - 1 :] if len(w) >= n else ends[-1:]
    digest = xxhash.xxh64_digest
    for at in range(0, k, 65536):
        yield b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : min(k, at + 65536)].tolist(), last[at : at + 65536].tolist())])


def fingerprint(text: str | None) -> int:
    """SimHash of a whole text; 0 if it has no word."""
    counts, k = np.zeros(64, np.int64), 0
    for part in shingle_hashes(text, SHINGLE):
        counts += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        k += len(part) // 8
    return int.from_bytes(np.packbits(counts * 2 > k).tobytes(), "big")


def widened(h: np.ndarray) -> np.ndarray:
    """``WIDE_WORDS`` hashes of each hash: itself, and finalised sums with multiples of an odd number."""
    out = [h]
    for k in range(1, WIDE_WORDS):
        z = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)  # fixed values: constants of SplitMix64
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        out.append(z ^ z >> np.uint64(31))
    return np.stack(out, axis=1)


def wide_fingerprint(text: str | None) -> list[int]:
    """SimHash of the distinct five-word shingles of a whole text, as 64-bit words; 0 if it has no word."""
    parts = [np.unique(np.frombuffer(p, ">u8")) for p in shingle_hashes(text, WIDE_SHINGLE)]
    h = np.unique(np.concatenate(parts)).astype(np.uint64) if parts else np.zeros(0, np.uint64)
    counts = np.zeros(64 * WIDE_WORDS, np.int64)
    for at in range(0, len(h), 8192):
        each = widened(h[at : at + 8192]).astype(">u8")
        counts += np.unpackbits(each.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(counts * 2 > len(h)).view(">u8").tolist()


def mapped(docs: DataFrame, text: str, names: list[str], of: Callable[[str | None], list[int]]) -> DataFrame:
    """The other columns of ``docs`` and the words that ``of`` makes of the text, as signed longs."""
    others = [c for c in without(docs, [text, *names])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([of(t.as_py()) for t in b.column(b.num_columns - 1)], np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(values[:, k]) for k in range(len(names))]], names=[*others, *names])

    source = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").cast("string"))
    schema = docs.select(*[F.col(f"`{c}`") for c in others], *[F.lit(0).cast("long").alias(n) for n in names]).schema
    return source.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` and ``fp``, the fingerprint as a signed long."""
    return mapped(docs, text, ["fp"], lambda t: [fingerprint(t)])


def hamming_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every 15-bit value: the error position (0: none) and the value's home codeword.

    Bit j of a value stands for position j + 1; the syndrome is the XOR of the positions of its set bits.
    """
    values = np.arange(1 << CODE)
    syndrome = np.zeros(1 << CODE, np.int64)
    for j in range(CODE):
        syndrome ^= np.where(values >> j & 1, j + 1, 0)
    home = np.where(syndrome > 0, values ^ (1 << np.maximum(syndrome - 1, 0)), values)
    return syndrome, home


def anchors(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, anchor, is_home) of each way to reach an anchor from uint64 fingerprints."""
    fp = fp.reshape(-1)
    _, home = hamming_tables()
    rows = np.arange(len(fp))
    for band, (first, width) in enumerate(BANDS):
        value = (fp >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1)
        code, free = value & ((1 << CODE) - 1), value >> CODE
        name = lambda c, f: band << 24 | f << CODE | c  # noqa: E731,B023
        own = name(home[code], free)
        yield rows, own, np.ones(len(fp), bool)
        seen = [own]
        for j in range(CODE):  # homes of values with one other code bit
            a = name(home[code ^ (1 << j)], free)
            new = np.logical_and.reduce([a != s for s in seen])
            seen.append(a)
            yield rows[new], a[new], np.zeros(int(new.sum()), bool)
        for j in range(width - CODE):  # homes of values with one other free bit
            yield rows, name(home[code], free ^ (1 << j)), np.zeros(len(fp), bool)


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of each bit; for each syndrome the error of weight ``RADIUS`` or less, and the patterns of the next
    weights up to ``RADIUS`` + ``MARGIN``, filled up with -1."""
    data = GOLAY_POLYNOMIAL.bit_length() - 1
    bit = []
    for i in range(GOLAY):
        rest = 1 << i
        for k in range(i, data - 1, -1):
            rest ^= (rest >> k & 1) * (GOLAY_POLYNOMIAL << (k - data))
        bit.append(rest)
    bits = np.array(bit)
    pattern, syndrome, top = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, -1)
    error, more = np.zeros(1 << data, np.int64), [[] for _ in range(1 << data)]
    for weight in range(1, RADIUS + MARGIN + 1):
        grown = [(pattern[top < i] | 1 << i, syndrome[top < i] ^ bits[i], i) for i in range(GOLAY)]
        top = np.concatenate([np.full(len(p), i) for p, _, i in grown])
        pattern, syndrome = (np.concatenate([g[k] for g in grown]) for k in (0, 1))
        if weight <= RADIUS:
            error[syndrome] = pattern
        else:
            for s, p in zip(syndrome.tolist(), pattern.tolist()):
                more[s].append(p)
    wide = max(map(len, more))
    return bits, error, np.array([m + [-1] * (wide - len(m)) for m in more])


def bands(n: int) -> list[np.ndarray]:
    """Bits of each band for ``n`` distinct fingerprints: of the code, then those that must be equal."""
    free = max(0, math.ceil(math.log2(max(n, 1) / CROWD)))
    width = GOLAY + free
    number = math.ceil(math.log(MISSED) / math.log1p(-MEET * (1 - DIFFER) ** free))
    each = 64 * WIDE_WORDS // width  # bands of one permutation share no bit
    orders = [np.random.default_rng(k).permutation(64 * WIDE_WORDS) for k in range(-(-number // each))]
    return [orders[k // each][k % each * width : (k % each + 1) * width] for k in range(number)]


def wide_anchors(fp: np.ndarray, chosen: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, anchor, is_home) of each way to reach an anchor from fingerprints of ``WIDE_WORDS`` words a row."""
    bits, error, more = golay_tables()
    rows = np.arange(len(fp))
    for band, places in enumerate(chosen):
        value, syndrome = np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64)
        for k, place in enumerate(places.tolist()):
            bit = (fp[:, place // 64] >> np.uint64(place % 64)).astype(np.int64) & 1
            value |= bit << k
            if k < GOLAY:
                syndrome ^= bit * bits[k]
        name = value | band << len(places)
        yield rows, name ^ error[syndrome], np.ones(len(fp), bool)
        for column in more.T:
            pattern = column[syndrome]
            some = pattern >= 0
            yield rows[some], name[some] ^ pattern[some], np.zeros(int(some.sum()), bool)


Reach = Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


class Splits:
    """Into how many blocks the homes and the copies of heavy anchors are split."""

    def __init__(self, counted: list[tuple[int, int, int]], block: int) -> None:
        """``counted``: (anchor, homes, rows); the rows of an anchor count as copies, its homes among them."""
        counted = sorted(counted)
        self.anchor = np.array([a for a, _, _ in counted], np.int64)
        self.homes, self.copies = (np.array([max(1, -(-x[k] // block)) for x in counted], np.int64) for k in (1, 2))

    def find(self, anchor: np.ndarray) -> np.ndarray:
        """Index of each anchor here, -1 if it is not split."""
        if not len(self.anchor):
            return np.full(len(anchor), -1)
        at = np.minimum(np.searchsorted(self.anchor, anchor), len(self.anchor) - 1)
        return np.where(self.anchor[at] == anchor, at, -1)


def dealt(rows: np.ndarray, own: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row with its own block and every block of the other side."""
    end = np.cumsum(others)
    return np.repeat(rows, others), np.repeat(own, others), np.arange(end[-1] if len(end) else 0) - np.repeat(end - others, others)


def matrix(columns: list[pa.Array]) -> np.ndarray:
    """Long columns as uint64, a row each."""
    return np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1).view(np.uint64)


def to_cells(batches: Iterator[pa.RecordBatch], splits: Splits, reach: Reach = anchors) -> Iterator[pa.RecordBatch]:
    """(cell, the columns of the batch, home) for every anchor.  In a split anchor a cell is a block of homes by a
    block of copies; homes are copies too, so that each pair of which one is a home meets in a cell.  The columns
    are the fingerprint, or a name and the words of it."""
    for b in batches:
        named = matrix(b.columns)
        fp = named if named.shape[1] == 1 else named[:, 1:]
        salt = ((fp[:, 0] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)  # fixed value: an odd multiplier near 2^64 / golden ratio
        for rows, anchor, home in reach(fp):
            at = splits.find(anchor)
            whole = at < 0
            parts = [(anchor[whole] << 20, rows[whole], home[whole])]
            if not whole.all():
                r, k, n = rows[~whole], at[~whole], anchor[~whole] << 20
                place = np.arange(len(r))
                i, copy, by_home = dealt(place, salt[r] % splits.copies[k], splits.homes[k])
                parts.append((n[i] | copy * splits.homes[k][i] + by_home, r[i], np.zeros(len(i), bool)))
                if home.all():
                    i, own, by_copy = dealt(place, salt[r] // 64 % splits.homes[k], splits.copies[k])
                    parts.append((n[i] | by_copy * splits.homes[k][i] + own, r[i], np.ones(len(i), bool)))
            cell, row, flag = (np.concatenate([p[j] for p in parts]) for j in range(3))
            for x in range(0, len(cell), 65536):
                part = slice(x, x + 65536)
                values = named[row[part]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell[part]), *[pa.array(values[:, k]) for k in range(values.shape[1])], pa.array(flag[part])], names=["cell", *b.schema.names, "home"])


class Forest:
    """Keeps the links that join two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (nxt := up.get(root, root)) != root:
            root = nxt
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def joins(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def apart(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, whose words are the last axis."""
    out = np.bitwise_count(u[..., 0] ^ v[..., 0])
    if u.shape[-1] > 1:
        out = out.astype(np.int16)
        for k in range(1, u.shape[-1]):
            out += np.bitwise_count(u[..., k] ^ v[..., k])
    return out


def walk(members: np.ndarray, distance: int = DISTANCE, fp: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Links that connect what is linked within a dense cell: each step compares one member with those
    that no step has reached yet, so a cell of close copies takes little more than one pass.  ``members`` are
    fingerprints of one word, or the names of ``fp``."""
    fp = members[:, None] if fp is None else fp
    rest, queue = np.arange(len(members)), []
    while len(rest) or queue:
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        x = queue.pop()
        near = apart(fp[rest], fp[x]) <= distance
        if near.any():
            found = rest[near]
            rest = rest[~near]
            queue.extend(found)
            yield from ((int(members[x]), y) for y in members[found].tolist())


def neighboured(fp: np.ndarray, distance: int) -> np.ndarray:
    """Which members of a cell have a neighbour."""
    out = np.zeros(len(fp), bool)
    step = max(1, CHUNK // len(fp))
    for at in range(0, len(fp), step):
        out[at : at + step] = (apart(fp[at : at + step, None], fp[None]) <= distance).sum(axis=1) > 1
    return out


def links_of(cell: np.ndarray, named: np.ndarray, home: np.ndarray, forest: Forest, distance: int) -> list[tuple[int, int]]:
    """Spanning links among whole cells, sorted by cell."""
    name, fp = named[:, 0], named if named.shape[1] == 1 else named[:, 1:]
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    out = []
    for s, n in zip(starts[sizes > DENSE].tolist(), sizes[sizes > DENSE].tolist()):
        members, at = np.unique(name[s : s + n], return_index=True)
        words = fp[s + at]
        if len(members) <= SINGLE:
            some = neighboured(words, distance)
            members, words = members[some], words[some]
        out += [x for x in walk(members, distance, words) if forest.joins(*x)]
    small = np.repeat(sizes <= DENSE, sizes) & home
    a = np.flatnonzero(small)
    of = np.repeat(np.arange(len(starts)), sizes)[a]
    width = max(1, CHUNK // DENSE)
    for at in range(0, len(a), width):
        x, g = a[at : at + width], of[at : at + width]
        left = np.repeat(x, sizes[g])
        begin = np.cumsum(sizes[g]) - sizes[g]
        right = np.arange(len(left)) - np.repeat(begin, sizes[g]) + np.repeat(starts[g], sizes[g])
        u, v = name[left], name[right]
        near = (apart(fp[left], fp[right]) <= distance) & (u != v)
        out += [p for p in zip(u[near].tolist(), v[near].tolist()) if forest.joins(*p)]
    return out


def links(batches: Iterator[pa.RecordBatch], distance: int = DISTANCE) -> Iterator[pa.RecordBatch]:
    """Links (a, b) from rows sorted by cell; holds one cell and one batch at a time."""
    forest, held = Forest(), None
    emit = lambda found: pa.RecordBatch.from_arrays([pa.array(np.array([p[k] for p in found], np.uint64).view(np.int64)) for k in (0, 1)], names=["a", "b"])
    for b in batches:
        new = (b.column(0).to_numpy(zero_copy_only=False), matrix(b.columns[1:-1]), b.column(b.num_columns - 1).to_numpy(zero_copy_only=False))
        held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
        if not len(held[0]):
            continue
        cut = int(np.searchsorted(held[0], held[0][-1]))  # the last cell may go on
        if cut:
            yield emit(links_of(*(x[:cut] for x in held), forest, distance))
            held = tuple(x[cut:] for x in held)
    if held is not None and len(held[0]):
        yield emit(links_of(*held, forest, distance))


def meetings(fps: DataFrame, block: int, distance: int, reach: Reach) -> DataFrame:
    """Links (a, b) found at the anchors.  ``fps`` is the fingerprint, or a name and the words of it."""
    none = Splits([], block)
    count = lambda batches: (pa.RecordBatch.from_arrays([x.column(0), x.column(x.num_columns - 1)], names=["cell", "home"]) for x in to_cells(batches, none, reach))
    sizes = fps.mapInArrow(count, "cell long, home boolean").groupBy("cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("rows"))
    many = sizes.where(F.col("rows") > block).select(F.shiftright("cell", 20), "homes", "rows").collect()  # at most 2^19 anchors
    splits = fps.sparkSession.sparkContext.broadcast(Splits([tuple(r) for r in many], block))
    schema = ", ".join(["cell long", *(f"{c} long" for c in fps.columns), "home boolean"])
    cells = fps.mapInArrow(lambda batches: to_cells(batches, splits.value, reach), schema)
    return cells.repartition(F.col("cell")).sortWithinPartitions("cell").mapInArrow(lambda batches: links(batches, distance), "a long, b long")


def near_links(fps: DataFrame, block: int = BLOCK, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column ``fp``) within the distance."""
    if distance > MOST_DISTANCE:
        raise ValueError(f"the bands cover {MOST_DISTANCE} bits at most")
    return meetings(fps, block, distance, anchors)


def wide_links(fps: DataFrame, block: int = BLOCK, distance: int = WIDE_DISTANCE) -> DataFrame:
    """Links (a, b) between the names (first column) of distinct wide fingerprints (the other columns)."""
    n = fps.count()
    chosen = bands(n)
    each = (math.comb(GOLAY, RADIUS + MARGIN) / len(golay_tables()[1]) + 1) * len(chosen)
    heavy = max(block, int(n * each) // MOST_HEAVY)
    return meetings(fps, heavy, distance, lambda fp: wide_anchors(fp, chosen))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """(__rid, key, fp, component_id, first_rid): one row per row of ``docs``; fingerprints link at ``distance``
    or fewer differing bits (``MOST_DISTANCE`` at most).

    ``component_id`` is the smallest key that can be reached, ``first_rid`` the row that has it.
    A null text is empty; texts without a word share fingerprint 0 and are linked.  Null keys come last:
    a component of nothing else has a null id.  Repeated keys share a component only by their texts.  A very
    long text is one row of its task, hashed in parts of bounded size; other columns are left out.
    ``docs`` has a row identity ``__rid`` or gets one.  An empty table gives no rows.
    """
    rows = scratch.materialise(fingerprints(prepared(docs, text, key)), "fingerprints")
    out = grouped(rows, ["fp"], F.col("fp"), lambda each: near_links(each.select("fp"), distance=distance))
    return out.select(RID, F.col("key").alias(key), "fp", "component_id", "first_rid")


def similar(docs: DataFrame, text: str = "text", key: str = "doc_id", distance: int = WIDE_DISTANCE) -> DataFrame:
    """(__rid, key, component_id, first_rid): as ``near_duplicates``, with links between texts whose wide
    fingerprints differ in ``distance`` or fewer bits, as those of texts do that share 0.8 or more of their
    five-word shingles.

    Texts of fewer than five words are one shingle.  Nulls, empty and very long texts, ties, repeated rows, other
    columns and empty tables as in ``near_duplicates``.  Of pairs at 0.8 one in ten is further apart or meets at
    no anchor, of more similar ones far fewer; pairs below 0.6 are hardly ever linked.
    """
    names = [f"w{k}" for k in range(WIDE_WORDS)]
    rows = scratch.materialise(mapped(prepared(docs, text, key), "text", names, wide_fingerprint), "fingerprints")
    out = grouped(rows, names, F.col(f"first.{RID}"), lambda each: wide_links(each.select("node", *names), distance=distance))
    return out.select(RID, F.col("key").alias(key), "component_id", "first_rid")


def prepared(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(__rid, key, text)"""
    if RID not in docs.columns:
        docs = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).withColumn(RID, F.monotonically_increasing_id())
    return docs.select(RID, F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))


def grouped(rows: DataFrame, names: list[str], node: Column, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with the component of their fingerprint, the columns ``names``; ``node`` tells distinct ones apart."""
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", RID)).alias("first")
    each = scratch.materialise(rows.groupBy(*names).agg(first).withColumn("node", node), "distinct")
    placed = scratch.materialise(each.join(components(link(each)), "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    best = scratch.materialise(placed.groupBy("root").agg(F.min("first").alias("best")), "best")
    named = scratch.materialise(placed.join(best, "root").select(*names, F.col("best.key").alias("component_id"), F.col(f"best.{RID}").alias("first_rid")), "named")
    return rows.join(named, names)
