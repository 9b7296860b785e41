import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelattice.llm import registry
from tracelattice.llm import sharding as S


@pytest.mark.parametrize("bucket_rows", [10, 65536])
def test_sizes_slots_and_rows(spark, bucket_rows):
    rows = [(i % 990 if i % 7 else None, "hot" if i % 3 else None, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(7)
    a = S.shuffle(df, 24, seed=3, bucket_rows=bucket_rows).collect()
    assert Counter((r.doc_id, r.text) for r in a) == Counter(r[:2] for r in rows)
    shards = {}
    for r in a:
        shards.setdefault(r.shard, []).append(r.slot)
    assert set(shards) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert {len(s) for s in shards.values()} == {41, 42}


def test_buckets_are_bounded_by_rows_and_bytes():
    assert S.buckets_per_shard(0, 0, 24) == 1 and S.buckets_per_shard(24 * 16_384, 10, 24) == 1 and S.buckets_per_shard(24 * 16_384 + 1, 10, 24) == 2
    assert S.buckets_per_shard(1_000, 24 * (640 << 20), 24) == 10


def test_very_long_texts_and_many_buckets(spark):
    rows = [(i, "é" * (3_000_000 if i < 4 else 5), None) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(5)
    got = S.shuffle(df, 3, bucket_bytes=1 << 20).select("doc_id", "shard", "slot", F.length("text")).collect()
    assert sorted((r[0], r[3]) for r in got) == [(i, len(t)) for i, t, _ in rows]
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(3) for k in range(17 if s < 2 else 16)]


def test_query_matches_brute_force(spark, tmp_path):
    texts = [None, "", "é\n", "日本", "same", "same"] + [f"text {i} " * (i % 9) for i in range(94)]
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op4_hypergeometric_sharding(spark, str(tmp_path)).collect()
    data = lambda t: (t or "").encode()
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got), key=str) == sorted(((k, len(data(t)) + 8, zlib.crc32(data(t)), "rows", None) for k, t, _ in rows), key=str)
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(24) for k in range(5 if s < 4 else 4)]


def test_same_table_same_order(spark, tmp_path):
    spark.range(300).repartition(5).write.parquet(str(tmp_path / "t"))
    one, two = (sorted(map(tuple, S.shuffle(spark.read.parquet(str(tmp_path / "t")), 4, seed=1).collect())) for _ in range(2))
    assert one == two != sorted(map(tuple, S.shuffle(spark.read.parquet(str(tmp_path / "t")), 4, seed=2).collect()))


def test_few_rows_and_none(spark):
    assert sorted((r.shard, r.slot) for r in S.shuffle(spark.range(3), 24).collect()) == [(0, 0), (1, 0), (2, 0)]
    assert S.shuffle(spark.range(0), 24).count() == 0


def test_matrix_has_exact_margins():
    before = np.concatenate(([0], np.cumsum([5, 0, 17, 40, 3, 35])))
    sizes = S.bucket_sizes(100, 3, 2)
    for seed in range(20):
        m = np.array([S.matrix_row(seed, before, sizes, p) for p in range(6)])
        assert (m >= 0).all() and m.sum(0).tolist() == sizes.tolist() and m.sum(1).tolist() == np.diff(before).tolist()


def test_matrix_law_matches_a_shuffle():
    before, sizes = np.array([0, 4, 10]), np.array([3, 7])
    drawn = Counter(int(S.matrix_row(s, before, sizes, 0)[0]) for s in range(6000))
    want = {0: 20 / 120 / 1, 1: 60 / 120, 2: 36 / 120, 3: 4 / 120}  # C(4,k) C(6,3-k) / C(10,3)
    assert all(abs(drawn[k] / 6000 - p) < 0.025 for k, p in want.items())


def test_draws_beyond_the_library_limit():
    rng = np.random.default_rng(0)
    x = np.array([S.hypergeometric(rng, 10**10, 3 * 10**10, 10**6) for _ in range(200)], float)
    assert abs(x.mean() - 250000) < 5 * 433 / 200**0.5 and 300 < x.std() < 600
    assert S.multivariate(rng, np.array([2 * 10**9, 10**9]), 3 * 10**9).tolist() == [2 * 10**9, 10**9]


def test_each_row_is_as_likely_anywhere(spark):
    df = spark.range(24).repartition(3).cache()
    seen = Counter()
    for seed in range(40):
        seen.update(r.shard for r in S.shuffle(df, 4, seed=seed, bucket_rows=2).where("id < 4").collect())
    assert all(20 < seen[s] < 62 for s in range(4))
