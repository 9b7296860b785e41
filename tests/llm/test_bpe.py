import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tracelattice.llm import bpe, registry

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def round_trip(spark, texts, size=bpe.CHUNK, overlap=bpe.OVERLAP, chunks=bpe.STRETCH):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN, size=size, overlap=overlap, chunks=chunks), PATH, public_tokenizers.PATTERN).collect()
    assert len(out) == len(texts)
    for r in out:
        t = texts[r.doc_id] or ""
        assert r.ids == LIBRARY.encode_ordinary(t) and bytes(r.decoded) == t.encode()


def sample():
    r = random.Random(2)
    alphabet = "ab é1 \n\t '’s。<|endoftext|>日本  \x1c\x85"
    out = [None, "", " ", "   \n  ", "it's 'll we've", "<|endoftext|> x", "a" * 300, " " * 300, "x " * 200 + " " * 100 + "'s" * 50]
    return out + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 400))) for _ in range(60)]


def test_whole_texts_as_the_library(spark):
    round_trip(spark, sample())


def test_small_chunks_are_stitched_exactly(spark):
    for size, overlap, chunks in ((40, 12, 32), (16, 3, 4), (16, 16, 2), (7, 2, 1)):
        round_trip(spark, sample(), size, overlap, chunks)


def test_stretches_agree_or_say_so():
    c = bpe.codec(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    r, agreed = random.Random(5), 0
    for n in range(1500):
        t = "".join(r.choice("ab é1 \n\t '’s。日") for _ in range(r.randint(0, 250))) + ("k" * r.randint(1, 90) + "  x " * r.randint(0, 30)) * (n % 3 == 0)
        size, overlap = r.choice(((40, 12), (16, 3), (16, 16)))
        assert c.stitched(t, size, overlap)[0] == c.pieces(t)
        parts = [(first, *c.stitched(x, size, overlap, first > 0, own)) for x, first, own in bpe.stretches(t, size, overlap, 3)]
        ends = [a + e if e >= 0 else -1 for a, _, _, e in parts]
        begins = [a + b if b >= 0 else -1 for a, _, b, _ in parts]
        if -1 not in begins + ends and begins[1:] == ends[:-1]:
            agreed += len(parts) > 1
            assert [p for x in parts for p in x[1]] == c.pieces(t)
    assert agreed > 400


def test_stored_texts_have_several_chunks(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.length("text")).collect()
    assert sum((n or 0) > bpe.CHUNK + bpe.OVERLAP for (n,) in texts) > 100


def test_query_matches_brute_force(spark, tmp_path):
    texts = [*sample(), *sample()[:3], "wort  \n" * 30000]
    spark.createDataFrame([(i if i != 5 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in enumerate(texts):
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((i if i != 5 else None, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    got = [tuple(r) for r in registry.op10_bpe_round_trip(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_ids_that_the_ranks_lack(spark):
    with pytest.raises(Exception, match="ranks lack"):
        bpe.decode(spark.createDataFrame([([1, 99_999_999],)], "ids array<int>"), PATH, public_tokenizers.PATTERN).collect()


def test_pre_tokens_of_every_character():
    c = bpe.codec(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(points), 4096):
        text = "".join(f"a{chr(i)}1{chr(i)} {chr(i)}  {chr(i)}b" for i in points[at : at + 4096])
        if c.ids(c.pieces(text)).tolist() != LIBRARY.encode_ordinary(text):
            bad = [hex(i) for i in points[at : at + 4096] if c.ids(c.pieces(t := f"a{chr(i)}1{chr(i)} {chr(i)}  {chr(i)}b")).tolist() != LIBRARY.encode_ordinary(t)]
            assert not bad, bad[:20]


def test_very_long_text_and_empty_table(spark):
    r = random.Random(4)
    round_trip(spark, ["".join(r.choice(["wort ", "x", "\n", " the", "12", "é"]) for _ in range(400000)), "k" * 150000, ("a b" + " " * 70000) * 4])
    none = spark.createDataFrame([], "doc_id long, text string")
    out = bpe.encode(none, PATH, public_tokenizers.PATTERN)
    assert bpe.decode(out, PATH, public_tokenizers.PATTERN).count() == 0
    assert bpe.decode(spark.range(1).select(F.lit(None).cast("array<int>").alias("ids")), PATH, public_tokenizers.PATTERN).first().decoded == b""
