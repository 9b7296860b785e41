import random

import numpy as np

from tracelattice.llm import decontaminate as D


def slow_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_matches_the_table():
    r = random.Random(1)
    for _ in range(60):
        a, b = ([r.randint(1, 5) for _ in range(r.randint(1, 15))] for _ in range(2))
        assert D.align(np.array(a), np.array(b))[0] == slow_align(a, b)


def corpus():
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(15, 50)))) for i in range(12)] + [(12, None), (13, "too short"), (14, "")]
    docs = [(0, None), (1, ""), (2, "w1 w2")]
    for n in range(40):
        body = [r.choice(vocabulary) for _ in range(150)]
        if n % 2:
            item = items[n % 12][1].split()
            for k in range(0, len(item), 7):  # every seventh word is another
                item[k] = "edited" if n % 4 == 1 else item[k]
            at = r.randrange(len(body))
            body[at:at] = item
        docs.append((len(docs), " ".join(body).title()))
    return docs + [docs[4], (None, docs[4][1])], items


def test_finds_what_full_alignment_finds(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, score string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(
        (str(k), i, s)
        for k, t in docs for i, u in items
        if len(D.words_of(u)) >= D.N and (s := slow_align(D.words_of(u), D.words_of(t))) >= D.LEAST * D.MATCH * len(D.words_of(u))
    )
    found = D.find(d, b).collect()
    assert sorted((str(r.doc_id), r.item_id, r.score) for r in found) == want and len(want) >= 20


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    docs, items = corpus()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted((str(r.doc_id), r.item_id, r.score) for r in D.find(d, b).collect())
    monkeypatch.setattr(D, "BLOCK_WORDS", 100)
    assert sorted((str(r.doc_id), r.item_id, r.score) for r in D.find(d, b).collect()) == whole


def test_very_long_texts_and_ties(spark):
    r = random.Random(2)
    word = lambda: f"v{r.randrange(5000)}"
    item = [f"item{k}" for k in range(20)]
    long = [word() for _ in range(300_000)]
    for at in (299_000, 150_000, 150_400):
        long[at : at + 20] = item
    d = spark.createDataFrame([(1, " ".join(long), 1), (None, " ".join(long[149_000:152_000]), 2)], "doc_id long, text string, row int")
    got = D.find(d, spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((str(x.doc_id), x.item_id, x.score, x.end_word) for x in got) == [("1", 7, 40, 150_020)] * 2 + [("None", 7, 40, 1_020)] * 2


def test_empty_tables(spark):
    docs, items = corpus()
    none = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert D.find(none, b).count() == 0
    assert D.find(spark.createDataFrame(docs, "doc_id long, text string"), b.limit(0)).count() == 0


def test_dense_edits_are_found(spark):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(15, 60)))) for i in range(30)]
    docs = []
    for i, t in items:
        for every in (3, 4, 5, 6):
            for insert in (False, True):
                w = t.split()
                for k in range(len(w) // every * every - 1, 0, -every):
                    w[k : k + (not insert)] = [f"edit{k}"]
                body = [r.choice(vocabulary) for _ in range(r.choice((0, 30, 900)))]
                at = r.randint(0, len(body))
                docs.append((len(docs), " ".join([*body[:at], *w, *body[at:]])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for k, t in docs:
        x = np.array([hash(w) for w in t.split()])
        want |= {(k, i, s) for i, u in items if (s := D.align(np.array([hash(w) for w in u.split()]), x)[0]) >= D.LEAST * D.MATCH * len(u.split())}
    assert {(r.doc_id, r.item_id, r.score) for r in D.find(d, b).collect()} == want
    assert {k for k, _, _ in want} >= {k for k in range(len(docs)) if k % 8 > 1}
