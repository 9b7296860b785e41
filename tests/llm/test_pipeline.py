import random
from pathlib import Path

import corpus_pipeline as P
from tests.llm import test_quality, test_simhash
from tests.llm.test_bpe import LIBRARY
from tests.llm.test_decontaminate import slow_align
from tracelattice.llm import decontaminate as D
from tracelattice.llm import quality, secrets, simhash


def corpus():
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, prose(30)) for i in range(5)] + [(5, None)]
    footer = prose(12)
    docs = []
    for i in range(60):
        lines = [prose(40) for _ in range(r.randint(2, 5))]
        if i % 5 == 0:
            lines.insert(1, items[i % 4][1])
        if i % 4 == 0:
            lines.append(f"token = '{r.getrandbits(160):040x}' end")
        if i % 2:
            lines.append(footer)
        docs.append("\n".join(lines))
    near = docs[1].split(" ")
    near[30] = "changed"
    docs += [docs[3], docs[7], docs[7], " ".join(near), None, "", "short text", footer + "\n" + prose(8), " ".join(["again and again"] * 60)]
    rows = [(i, t, "en", f"host{i % 2}" if i % 9 else None, 0 if t is None else len(t)) for i, t in enumerate(docs)]
    return [*rows, rows[10], rows[10]], items


def brute(rows, items):
    verdicts = test_quality.brute([(r[1], r[3]) for r in rows], quality.MAX_DOCS)
    many = test_quality.frequent([(r[1], r[3]) for r in rows], quality.MAX_DOCS)
    kept = []
    for row, v in zip(rows, verdicts):
        if v[-1]:
            kept.append((row[0], "\n".join(raw for raw, line, _ in test_quality.lines_of(row[1]) if (row[3] or "", line) not in many)))
    groups = test_simhash.groups([(k, test_simhash.slow_wide(t)) for k, t in kept], simhash.WIDE_DISTANCE)
    first, left = set(), []
    for (k, t), g in sorted(zip(kept, groups), key=lambda x: x[0][0]):
        if g not in first:
            first.add(g)
            left.append((k, t))
    held = [D.words_of(t) for _, t in items if len(D.words_of(t)) >= D.N]
    left = [(k, t) for k, t in left if all(slow_align(i, D.words_of(t)) < D.LEAST * D.MATCH * len(i) for i in held)]
    out = {}
    for k, t in left:
        text, at, end = "", 0, 0
        for a, _, _, b in secrets.find(t):
            if a > end or not text:
                text, at = text + t[at:a] + "[SECRET]", b
            at = end = max(at, b)
        out[k] = LIBRARY.encode_ordinary(text + t[at:])
    return out, len(kept), len(first)


def test_stages_match_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want, after_quality, after_dedup = brute(rows, items)
    docs, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in P.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != P.STAGES[-1][0]:
            assert docs.columns == P.COLUMNS and all(r.n_chars == len(r.text) for r in docs.collect())
    assert counts[:2] == [after_quality, after_dedup] and after_dedup < after_quality < len(rows) and len(want) < after_dedup
    assert {r.doc_id: r.ids for r in docs.collect()} == want and counts[-1] == len(want)
    assert {r.doc_id: r.ids for r in P.run(spark, str(tmp_path)).collect()} == want


def test_null_columns_long_texts_and_clashing_names(spark, tmp_path):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    body = lambda n: " ".join(word() for _ in range(n))
    long = body(150_000) + " token = 'abcdefgh12345678' " + body(100)
    rows = [(None, body(80), None, None, None), (None, body(80), None, None, 3), (1, long, "en", "h", 0), (2, None, "en", "h", None), (3, "", None, "h", 1)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(*x, "a", 1, "b", True, "c", 0, "d") for x in rows], columns + ", ids string, h int, fp string, kept boolean, blob string, __rid int, host string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, body(30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = P.run(spark, str(tmp_path)).collect()
    assert sorted(str(x.doc_id) for x in got) == ["1", "None", "None"]
    masked = long[: long.index("token")] + "[SECRET]" + long[long.index("' ", long.index("token")) :]
    assert next(x.ids for x in got if x.doc_id == 1) == LIBRARY.encode_ordinary(masked)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES:  # a stage takes tables with more columns, too
        out = stage(spark, docs.drop("__rid"), str(tmp_path))
        assert out.count() <= 5 and (name == "encoding" or out.columns == P.COLUMNS), name


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_no_data_in_the_repository():
    assert not list((Path(P.__file__).parent).rglob("*.tiktoken"))
