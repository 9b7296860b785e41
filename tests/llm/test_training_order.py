import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.test_bpe import LIBRARY, PATH
from tracelattice.llm import registry
from tracelattice.llm import training_order as O


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64, 1000, 4097])
def test_slots_are_a_permutation(n):
    a = O.slots(np.arange(n), n, 7)
    assert sorted(a.tolist()) == list(range(n))
    if n > 60:
        assert (a != O.slots(np.arange(n), n, 8)).any() and abs(np.corrcoef(np.arange(n), a)[0, 1]) < 0.35


def texts():
    r = random.Random(3)
    return [None, ""] + [" ".join(r.choice(["alpha", "beta", "über", "1\n", "\n"]) for _ in range(r.randint(1, 400))) for _ in range(60)] + ["x " * 50000]


@pytest.mark.parametrize("waves", [1, 3, 50])
def test_shards_hold_every_sequence_at_its_slot(spark, tmp_path, waves):
    data = texts()
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(data)], "doc_id long, text string, slot long").repartition(4)
    path = str(tmp_path / "s")
    placed = O.materialise(df, path, PATH, public_tokenizers.PATTERN, 5, length=16, rows=300, waves=waves).collect()
    want = {(i, k // 16): ids[k : k + 16] for i, t in enumerate(data) for ids in [LIBRARY.encode_ordinary(t or "")] for k in range(0, len(ids), 16)}
    at = {r.slot: (r.doc_id, r.seq) for r in placed}
    assert sorted(at) == list(range(len(want))) and all((r.shard, r.offset) == (r.slot // 300, r.slot % 300 * 33) for r in placed)
    got = {r.slot: r.tokens for r in O.read(spark, path, 16, 300).collect()}
    assert {at[s]: t for s, t in got.items()} == want and len(got) == len(want)
    assert {r.slot for r in O.read(spark, path, 16, 300, start=450).collect()} == set(range(450, len(want)))


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert O.materialise(df, str(tmp_path / "s"), PATH, public_tokenizers.PATTERN).count() == 0


def test_tasks_have_whole_shards_and_share_them_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(O, "TASK_BYTES", 700)  # two shards of ten records of 33 bytes
    df = spark.createDataFrame([(i, "alpha beta " * 40) for i in range(128)], "doc_id long, text string").repartition(4)
    path = tmp_path / "s"
    O.materialise(df, str(path), PATH, public_tokenizers.PATTERN, 5, length=16, rows=10, waves=1)
    files = [f for f in path.rglob("part-*") if f.suffix != ".crc"]
    tasks = {f.name.split("-")[1] for f in files}
    shards = {f.parent.name for f in files}
    assert len(files) == len(shards) and len(tasks) == -(-len(shards) // 2)


def test_ids_must_fit_a_record(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(O, "FILL", 100)
    df = spark.createDataFrame([(1, "many other words")], "doc_id long, text string")
    with pytest.raises(Exception, match="do not fit"):
        O.materialise(df, str(tmp_path / "s"), PATH, public_tokenizers.PATTERN)


def test_a_lost_slot_is_an_error(spark):
    placed = spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "doc_id long, slot long, shard long")
    stored = spark.createDataFrame([(0, [1])], "slot long, tokens array<int>")
    assert O.verified(placed.where("slot = 0"), stored).first().tokens == [1]
    for a, b in ((placed, stored), (placed.where("slot = 1"), stored)):
        with pytest.raises(Exception, match="slot 1|slot 0"):
            O.verified(a, b).collect()


def test_query_matches_brute_force(spark, tmp_path):
    data = [*texts()[:20], "again", "again"]
    spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(data)], "doc_id long, text string, tokens string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op3_training_order(spark, str(tmp_path)).collect()
    want = {(i if i != 3 else None, k // O.LENGTH): ids[k : k + O.LENGTH] for i, t in enumerate(data) for ids in [LIBRARY.encode_ordinary(t or "")] for k in range(0, len(ids), O.LENGTH)}
    hashes = {tuple(r.t): r.h for r in spark.createDataFrame([(v,) for v in want.values()], "t array<int>").select("t", F.xxhash64("t").alias("h")).collect()}
    assert sorted(r.slot for r in got) == list(range(len(want))) and all((r.shard, r.offset) == (0, r.slot * (2 * O.LENGTH + 1)) for r in got)
    assert {(r.doc_id, r.seq): (r.n_tokens, r.n_stored, r.tokens_hash) for r in got} == {k: (len(v), len(v), hashes[tuple(v)]) for k, v in want.items()}
