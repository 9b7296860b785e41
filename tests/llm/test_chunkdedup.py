import random
from collections import defaultdict
from itertools import groupby

import numpy as np

from tracelattice.llm import chunkdedup as C


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgéhi") for _ in range(r.randint(1, 9))) for _ in range(n))


def corpus():
    r = random.Random(8)
    passages = [prose(r, r.randint(52, 80)) for _ in range(5)]
    docs = [None, "", "a", "é" * 3000]
    for i in range(60):
        t = [prose(r, r.randint(20, 150)) for _ in range(3)]
        if i % 2:
            t.insert(r.randint(0, 3), passages[i % 5])
        docs.append(r.choice(" \n").join(t))
    return docs + [docs[5], docs[4]], passages


def test_chunks_tile_and_resist_insertions():
    r = random.Random(1)
    for t in ("", "x", "é" * 999, prose(r, 3000), "a" * 5000, "日本語" * 500):
        data = t.encode()
        e = C.cuts(data)
        assert e == sorted(set(e)) and (e[-1] == len(data) if data else e == [])
        sizes = np.diff([0, *e])
        assert (sizes <= C.MOST).all() and (sizes[:-1] >= min(C.LEAST, C.MOST - 3)).all()
        assert b"".join(x.decode().encode() for x in (data[a:b] for a, b in zip([0, *e], e))) == data
    long = prose(r, 3000).encode()
    pieces = lambda d: {d[a:b] for a, b in zip([0, *C.cuts(d)], C.cuts(d))}
    changed = long[:5000] + b"inserted words" + long[5000:]
    assert len(pieces(long) - pieces(changed)) <= 6


def test_hash_is_the_rolling_one():
    data = prose(random.Random(2), 400).encode()
    h, marks = 0, []
    for i, b in enumerate(data):
        h = ((h << 1) + int(C.GEAR[b])) & 0xFFFFFFFF
        window = 0
        for k in range(min(16, i + 1)):
            window = (window + (int(C.GEAR[data[i - k]]) << k)) & 0xFFFFFFFF
        assert (h ^ window) & 0xFFFF == 0 or i < 16 or (h - window) % (1 << 16) == 0
        if window >> (16 - C.BITS) & ((1 << C.BITS) - 1) == 0:
            marks.append(i + 1)
    ends, last = [], 0
    for e in marks:
        if e - last >= C.LEAST and e - last <= C.MOST and (e == len(data) or data[e] & 0xC0 != 0x80):
            ends.append(e)
            last = e
    assert [x for x in C.cuts(data) if x in set(marks)] == ends


def brute(docs):
    """Runs of chunks that other documents have too, cut where the first of their kind end."""
    have, place, parts = defaultdict(set), {}, []
    for i, t in enumerate(docs):
        data = (t or "").encode()
        e = C.cuts(data)
        parts.append([(data[a:b], a, b) for a, b in zip([0, *e], e)])
        for k, (p, _, _) in enumerate(parts[-1]):
            have[p].add(i)
            place.setdefault(p, (i, k))
    out = []
    for i, chunks in enumerate(parts):
        data, run = (docs[i] or "").encode(), []
        words = lambda cs: sum(1 for _, a, b in cs for k in range(a, b) if not data[k : k + 1].isspace() and (k == 0 or data[k - 1 : k].isspace()))  # noqa: E731,B023
        for k, c in enumerate([*chunks, None]):
            if c and len(have[c[0]]) > 1:
                run.append((place[c[0]] == (i, k), c))
                continue
            if words([c for _, c in run]) >= C.MIN_WORDS:
                for first, group in groupby(run, lambda x: x[0]):
                    cs = [c for _, c in group]
                    out.append((i, len(data[: cs[0][1]].decode()), len(data[: cs[-1][2]].decode()), words(cs), min(len(have[x[0]]) for x in cs), first))
            run = []
    return sorted(out)


def test_repeats_match_brute_force(spark):
    docs, passages = corpus()
    df = spark.createDataFrame([(t, i, "x") for i, t in enumerate(docs)], "text string, doc_id long, start string").coalesce(1)
    got = sorted(tuple(r) for r in C.repeats(df).collect())
    assert got == brute(docs)
    assert any(g[-1] for g in got) and not all(g[-1] for g in got)
    held = {i for i, t in enumerate(docs) if any(p in (t or "") for p in passages)} | {4, 5, len(docs) - 2, len(docs) - 1}
    assert {g[0] for g in got} == held


def test_every_passage_keeps_one_first_copy(spark):
    r = random.Random(3)
    a, b = prose(r, 90), prose(r, 90)
    docs = [a, a + " " + b, a + " " + b, b + "\n" + b, prose(r, 90), a]
    got = [tuple(x) for x in C.repeats(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1)).collect()]
    assert sorted(got) == brute(docs)
    left = list(docs)
    for i, start, end, _, _, first in sorted(got, reverse=True):
        if not first:
            left[i] = left[i][:start] + left[i][end:]
    middle = lambda t: t[len(t) // 3 : 2 * len(t) // 3]
    assert [sum(t.count(middle(x)) for t in left) for x in (a, b, docs[4])] == [1, 1, 1]


def test_long_texts_null_keys_and_other_columns(spark):
    r = random.Random(4)
    long, passage = prose(r, 200_000), prose(r, 60)
    docs = [(None, long, 1), (None, passage + " " + prose(r, 30), 2), (7, long[:500_000] + " " + passage, 3)]
    got = C.repeats(spark.createDataFrame(docs, "doc_id long, text string, n_docs int").coalesce(1)).collect()
    assert got[0].asDict().keys() == {"doc_id", "start", "end", "n_words", "n_docs", "is_first"} and {x.doc_id for x in got} == {None, 7}
    assert max(x.end - x.start for x in got) > 499_000 and sum(x.is_first for x in got) == 2


def test_recall_of_passages_of_fifty_words(spark):
    """Documents of the stored table that share 50 words on end with another one, against what is reported."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: (r.text or "").split() for r in table.select("doc_id", "text").collect()}
    seen = defaultdict(set)
    for k, w in texts.items():
        for i in range(len(w) - 49):
            seen[hash(tuple(w[i : i + 50]))].add(k)
    shared = set().union(*(v for v in seen.values() if len(v) > 1))
    found = {r.doc_id for r in C.repeats(table).collect()}
    assert len(shared) > 100 and len(shared & found) >= 0.99 * len(shared)


def test_empty_table(spark):
    assert C.repeats(spark.createDataFrame([], "text string, doc_id long")).count() == 0
