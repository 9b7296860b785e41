import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tracelattice.llm import registry, simhash
from tracelattice.llm.components import components


def slow_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_wide(text):
    def mix(h, k):
        z = (h + k * 0x9E3779B97F4A7C15) % 2**64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        return z ^ z >> 31

    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles(text)]
    out = 0
    for k in range(simhash.WIDE_WORDS):
        each = [mix(x, k) if k else x for x in h]
        out = out << 64 | sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in each) > len(each))
    return out


def groups(values, distance=4):
    """values: (key, fingerprint); the smallest key of each component by brute force."""
    up = list(range(len(values)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i][1] ^ values[j][1]).bit_count() <= distance:
                up[max(find(i), find(j))] = min(find(i), find(j))
    return [min((values[j][0] for j in range(len(values)) if find(j) == find(i) and values[j][0] is not None), default=None) for i in range(len(values))]


def texts():
    r = random.Random(3)
    vocabulary = [f"wörd{i}" for i in range(300)]
    base = [[r.choice(vocabulary) for _ in range(r.choice((60, 200, 400)))] for _ in range(12)]
    out = [None, "", " \n\t", "one", "ONE", "one two three", "Ünë two three four five", "  x"]
    for b in base:
        out.append(" ".join(b))
        for _ in range(8):
            c = list(b)
            for _ in range(r.randint(0, 3)):
                c[r.randrange(len(c))] = r.choice(vocabulary)
            out.append(r.choice((" ", "\n")).join(c))
    return out + [" ".join(r.choice(vocabulary) for _ in range(70000))]


def test_components_match_brute_force(spark):
    t = texts()
    rows = [(i if i != 9 else None, x, "clash", i) for i, x in enumerate(t)] + [(5, t[8], "again", 0)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, key long").repartition(5)
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    fps = [(r[0], slow_fingerprint(r[1])) for r in rows]
    assert got == sorted(((k, f, c) for (k, f), c in zip(fps, groups(fps))), key=str)
    assert len({g[2] for g in got}) < len(got)


def test_links_connect_all_within_distance(spark):
    r = random.Random(5)
    centre = [r.getrandbits(64) for _ in range(20)]
    fps = {c for c in centre}
    for c in centre[:6]:
        for _ in range(150):
            x = c
            for b in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [(int(np.uint64(x).astype(np.int64)),) for x in fps]
    df = spark.createDataFrame(signed, "fp long")
    for block, distance in ((simhash.BLOCK, 4), (50, 4), (7, 4), (50, 5)):  # small blocks: anchors are split
        want = groups([(f, f) for f in fps], distance)
        found = {x.node & (2**64 - 1): x.root & (2**64 - 1) for x in components(simhash.near_links(df, block, distance)).collect()}
        for a in range(0, len(fps), 7):
            for b in range(len(fps)):
                assert (found.get(fps[a], fps[a]) == found.get(fps[b], fps[b])) == (want[a] == want[b])


def test_cells_of_split_anchors_are_bounded_and_lose_no_pair():
    r = np.random.default_rng(2)
    centre = r.integers(0, 2**64, dtype=np.uint64)
    fp = np.unique([centre ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, 3, dtype=np.uint64)) for _ in range(600)])
    batch = lambda: iter([pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64))], names=["fp"])])
    members = lambda splits: [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in simhash.to_cells(batch(), splits)]) for k in range(3)]
    cell, _, home = members(simhash.Splits([], 40))
    counted = [(int(c) >> 20, int(home[cell == c].sum()), int((cell == c).sum())) for c in np.unique(cell) if (cell == c).sum() > 40]
    met = lambda cell, value, home: {(a, b) for c in np.unique(cell) for a in value[(cell == c) & home] for b in value[cell == c] if a != b}
    split = members(simhash.Splits(counted, 40))
    assert len(counted) > 3 and met(*split) == met(*members(simhash.Splits([], 40)))
    assert max(np.unique(split[0], return_counts=True)[1]) < 4 * 40


def test_query_matches_brute_force(spark, tmp_path):
    data = [(i if i != 9 else None, t, "x") for i, t in enumerate(texts())]
    spark.createDataFrame(data, "doc_id long, text string, fingerprint string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    fps = [(k, slow_fingerprint(t)) for k, t, _ in data]
    want = sorted(((k, f"{f:016x}", c) for (k, f), c in zip(fps, groups(fps))), key=str)
    assert sorted((tuple(r) for r in registry.op8_simhash_anchor_covering(spark, str(tmp_path)).collect()), key=str) == want


def test_larger_distances_are_refused(spark):
    with pytest.raises(ValueError, match="5 bits"):
        simhash.near_links(spark.range(3).withColumnRenamed("id", "fp"), distance=6)


def test_every_pair_within_a_band_bit_meets():
    r = np.random.default_rng(1)
    fp = r.integers(0, 2**64, 200, dtype=np.uint64)
    for bit in range(64):
        other = fp ^ np.uint64(1 << bit)
        home = {(i, a) for rows, anchor, is_home in simhash.anchors(fp) for i, a, h in zip(rows, anchor, is_home) if h}
        reached = {(i, a) for rows, anchor, _ in simhash.anchors(other) for i, a in zip(rows, anchor)}
        missing = home - reached
        assert not missing, (bit, len(missing))


def test_wide_fingerprints():
    for t in texts():
        assert sum(x << 64 * (3 - k) for k, x in enumerate(simhash.wide_fingerprint(t))) == slow_wide(t)


def test_golay_anchors_cover_and_every_pair_within_the_margin_meets():
    r = np.random.default_rng(1)
    for n in (1, simhash.CROWD * 3):
        chosen = simhash.bands(n)
        fp = r.integers(0, 2**64, (40, simhash.WIDE_WORDS), dtype=np.uint64)
        reach = lambda x: [(band, i, a, h) for band, c in enumerate(chosen) for rows, anchor, home in simhash.wide_anchors(x, [c]) for i, a, h in zip(rows.tolist(), anchor.tolist(), home.tolist())]  # noqa: E731,B023
        homes = {(band, i, a) for band, i, a, h in reach(fp) if h}
        assert len(homes) == 40 * len(chosen)  # one home in each band
        for band, place in [(b, p) for b in range(len(chosen)) for p in chosen[b][: simhash.GOLAY : 5].tolist()]:
            other = fp.copy()
            other[:, place // 64] ^= np.uint64(1 << place % 64)
            got = {(b, i, a) for b, i, a, _ in reach(other)}
            assert {x for x in homes if x[0] == band} <= got
    assert len(simhash.bands(10**9)) > len(simhash.bands(10**7)) > len(simhash.bands(10**5)) == len(simhash.bands(0))


def test_wide_links_connect_what_is_within_distance(spark):
    r = random.Random(5)
    centre = [r.getrandbits(256) for _ in range(300)]
    fps = set(centre)
    for c in centre[:8]:
        for _ in range(90):
            x = c
            for b in r.sample(range(256), r.randint(1, 16)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = lambda x: int(np.uint64(x % 2**64).astype(np.int64))
    df = spark.createDataFrame([(i, *(signed(x >> 64 * k) for k in (3, 2, 1, 0))) for i, x in enumerate(fps)], "node long, w0 long, w1 long, w2 long, w3 long")
    want = groups(list(enumerate(fps)), simhash.WIDE_DISTANCE)
    for block in (simhash.BLOCK, 30):  # small blocks: anchors are split
        found = {x.node: x.root for x in components(simhash.wide_links(df, block)).collect()}
        got = [found.get(i, i) for i in range(len(fps))]
        first = {}
        assert [first.setdefault(g, i) for i, g in enumerate(got)] == want


def test_similar_finds_texts_that_share_most_shingles_and_no_others(spark):
    r = random.Random(8)
    vocabulary = [f"word{i}" for i in range(2000)]
    rows, pairs = [], []
    for i in range(400):
        base = [r.choice(vocabulary) for _ in range(r.choice((60, 150, 500)))]
        near = list(base)
        while True:  # edits of one word each, while 0.8 of the shingles are shared
            more = list(near)
            more[r.randrange(len(more))] = r.choice(vocabulary)
            a, b = shingles(" ".join(base)), shingles(" ".join(more))
            if len(a & b) < 0.8 * len(a | b):
                break
            near = more
        rows += [(2 * i, " ".join(base), 1), (2 * i + 1, " \n".join(near).upper(), 2)]
        pairs.append((2 * i, 2 * i + 1))
    rows += [(900, None, 0), (901, "", 0), (902, "\t", 0), (None, "one", 0), (904, "ONE ", 0), (905, rows[0][1], 0), (905, rows[0][1], 0), (906, " ".join(r.choice(vocabulary) for _ in range(70000)), 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node long").repartition(5)
    out = simhash.similar(df).collect()
    assert len(out) == len(rows)
    got = {x.doc_id: x.component_id for x in out}
    caught = sum(got[a] == got[b] for a, b in pairs)
    assert caught >= 0.9 * len(pairs)  # all of them just above 0.8, the hardest
    groups_of = {}
    for x in out:
        groups_of.setdefault(x.component_id, set()).add(x.doc_id)
    allowed = [{a, b} for a, b in pairs] + [{0, 1, 905}, {900, 901, 902}, {None, 904}, {906}]
    assert all(any(g <= a for a in allowed) for g in groups_of.values())
    assert got[900] == got[901] == got[902] == 900 and got[None] == got[904] == 904 and got[905] == got[0]


def test_empty_table(spark):
    assert simhash.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert components(df.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))).count() == 0


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[i] for i in range(100, 160)}) == 1 and got[200] == got[201]
    assert len(set(got.values())) == 3


def test_walk_links_only_what_is_near():
    x = np.array([0, 1, 3, 2**40 - 1, 2**40 - 2, 0b111111], np.uint64)
    assert sorted(map(sorted, simhash.walk(x))) == [[0, 1], [0, 3], [3, 63], [2**40 - 2, 2**40 - 1]] or len(list(simhash.walk(x))) == 4
    assert list(simhash.links(iter([pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.bool_())], names=["cell", "fp", "home"])]))) == []
