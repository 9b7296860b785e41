"""Benchmark decontamination: exact bounds by words, then Smith-Waterman alignment.

The test items are the query set.  They are taken in blocks of at most ``BLOCK_WORDS`` words, so what is
sent to the executors has a fixed bound; each block costs one pass over the texts, and no text is
shuffled or written.

1. Each text becomes numbers: the item vocabulary's, 0 for any other word.  It is cut into segments that
   overlap by the longest stretch that an alignment can cover, so each alignment lies whole in one.
2. Two bounds leave out items that no alignment in a segment can reach: the words of the item that the
   segment has at all, and the best stretch if each word of the item counts as a match, wherever it is.
   Both are upper bounds of the score, so nothing that reaches ``LEAST`` is lost, however dense the edits.
3. What is left is aligned; the score (match 2, mismatch and gap -1) is kept if it reaches ``LEAST`` of the
   item's best.

Defined cases: null texts are empty; a very long text is worked on segment by segment in one task; an item of
fewer than ``N`` words matches nothing; repeated documents or items are each reported; of places of equal score
the first counts; null ids are reported as null; other columns are left out; no documents or items: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelattice.llm.common import RID, whole

N = 3
LEAST = 0.5
MATCH, MISS, GAP = 2, -1, -1
BLOCK_WORDS = 1_000_000
SCAN_ROWS = 512
CELLS = 1 << 20  # items times words that are bounded at a time
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Items:
    """A block of items as numbers, and the items of each word; those of fewer than ``N`` words are left out."""

    def __init__(self, items: list[tuple[int | None, list[str]]]) -> None:
        self.items = [x for x in items if len(x[1]) >= N]
        self.number: dict[str, int] = {}
        self.ids = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int64) for _, words in self.items]
        self.length = np.array([len(x) for x in self.ids], np.int64)
        self.least = LEAST * MATCH * self.length
        #: Words of a text that an alignment can cover: all of the item's, and as many others as its score can bear.
        self.span = int((self.length + MATCH * self.length - self.least).max(initial=1))
        own = [np.unique(x, return_counts=True) for x in self.ids]
        word = np.concatenate([*(w for w, _ in own), np.zeros(0, np.int64)])
        order = np.argsort(word, kind="stable")
        self.item_of = np.repeat(np.arange(len(own)), [len(w) for w, _ in own])[order] if own else word
        self.times = np.concatenate([*(n for _, n in own), np.zeros(0, np.int64)])[order]
        self.starts = np.searchsorted(word[order], np.arange(len(self.number) + 2))

    def numbers(self, words: list[str]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in words], np.int64)

    def reachable(self, ids: np.ndarray) -> list[int]:
        """Items whose alignment with ``ids`` may reach the least score."""
        known, where = np.unique(ids, return_inverse=True)
        first, n = self.starts[known], self.starts[known + 1] - self.starts[known]
        n[known == 0] = 0
        column = np.repeat(np.arange(len(known)), n)
        at = np.arange(len(column)) - np.repeat(np.cumsum(n) - n - first, n)
        item = self.item_of[at]
        have = np.bincount(item, self.times[at], minlength=len(self.ids))
        some = np.flatnonzero(MATCH * have >= self.least)
        out: list[int] = []
        step = max(1, CELLS // max(1, len(ids)))
        for k in range(0, len(some), step):
            part = some[k : k + step]
            row = np.full(len(self.ids), -1, np.int32)
            row[part] = np.arange(len(part))
            mine = row[item] >= 0
            gain = np.full((len(part), len(known)), MISS, np.int32)
            gain[row[item[mine]], column[mine]] = MATCH
            total = np.zeros((len(part), len(ids) + 1), np.int32)
            np.cumsum(gain[:, where], axis=1, out=total[:, 1:])
            best = (total - np.minimum.accumulate(total, axis=1)).max(axis=1)
            out += part[best >= self.least[part]].tolist()
        return out


def align(item: np.ndarray, place: np.ndarray) -> tuple[int, int]:
    """Best local alignment: (score, end in ``place``)."""
    width = np.arange(len(place) + 1)
    row, best, end = np.zeros(len(place) + 1, np.int64), 0, 0
    for x in item.tolist():
        step = np.where(place == x, MATCH, MISS)
        new = np.zeros_like(row)
        new[1:] = np.maximum(np.maximum(row[:-1] + step, row[1:] + GAP), 0)
        # A gap along the text costs GAP a word, so the best earlier cell is a running maximum.
        row = np.maximum(new, np.maximum.accumulate(new - GAP * width) + GAP * width)
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def contaminations(ids: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """(item, score, end) of every item that a text holds; the best place of each."""
    best: dict[int, tuple[int, int]] = {}
    if not items.ids:
        return
    for a in range(0, max(1, len(ids) - items.span), 2 * items.span):
        place = ids[a : a + 3 * items.span]
        for item in items.reachable(place):
            score, end = align(items.ids[item], place)
            if score >= items.least[item] and score > best.get(item, (0, 0))[0]:
                best[item] = score, a + end
    yield from ((i, s, e) for i, (s, e) in best.items())


def blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int | None, list[str]]]]:
    """The items in blocks of bounded size; one partition at a time comes to the driver."""
    block: list[tuple[int | None, list[str]]] = []
    size = 0
    for r in benchmark.select(F.col(f"`{item}`"), F.col(f"`{text}`")).toLocalIterator():
        words = words_of(r[1])
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r[0], words))
        size += len(words)
    if block:
        yield block


def find_block(docs: DataFrame, items: Items, text: str, key: str) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items)  # at most BLOCK_WORDS words

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, SCAN_ROWS):
                b = whole_batch.slice(at, SCAN_ROWS)
                out = [(i, *c) for i, t in enumerate(b.column(2).to_pylist()) for c in contaminations(items.numbers(words_of(t)), items)]
                take = pa.array([o[0] for o in out], pa.int64())
                numbers = lambda v: pa.array(v, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), numbers([items.items[o[1]][0] for o in out]), numbers([o[2] for o in out]), numbers([len(items.ids[o[1]]) for o in out]), numbers([o[3] for o in out])],
                    names=["row", "key", "item_id", "score", "item_words", "end_word"],
                )

    source = docs.select(F.monotonically_increasing_id() if RID not in docs.columns else F.col(RID), F.col(f"`{key}`").alias("key"), whole(F.col(f"`{text}`")))
    key_type = docs.schema[key].dataType.simpleString()
    return source.mapInArrow(score, f"row long, key {key_type}, item_id long, score long, item_words long, end_word long")


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(row, key, item_id, score, item_words, end_word) of every document that holds an item; ``row`` is
    ``__rid`` where ``docs`` has it."""
    key_type = docs.schema[key].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"row long, key {key_type}, item_id long, score long, item_words long, end_word long")
    parts = [find_block(docs, Items(b), text, key) for b in blocks(benchmark, item, text)]
    for k, p in enumerate(parts):
        out = p if k == 0 else out.unionByName(p)
    return out.withColumnRenamed("key", key)
