import random

import pytest

from tests.test_pattern import PATTERNS, frame, span
from tracelattice.operators import structure
from tracelattice.plans import catalogue
from tracelattice.plans.planner import search
from tracelattice.sources.derived import order_spans

SF = "/root/testdata/sf0.001"


def forest():
    """Random traces, some with orphans, rings, repeated or missing ids, or deeper than they are hashed."""
    r, rows = random.Random(3), []
    for t in range(120):
        n = r.randint(1, 9)
        for i in range(n):
            parent = None if i == 0 and r.random() < 0.8 else r.choice([f"{t}.{j}" for j in range(n if r.random() < 0.1 else max(i, 1))] + ["gone", None])
            rows.append(span(f"t{t}", f"{t}.{0 if r.random() < 0.02 else i}" if r.random() < 0.98 else None, parent, r.choice(["X", "Y", "Zé", None])))
    return rows


def test_hashes_by_trace_are_those_by_joins(spark, monkeypatch):
    df = frame(spark, forest()).repartition(5)
    want = sorted(map(tuple, structure.structure_hashes(df, 4).collect()))
    parts = [df.where("abs(hash(trace_id)) % 3 = " + str(k)) for k in range(3)]
    assert sorted(map(tuple, structure.class_table(parts, 4).collect())) == want
    monkeypatch.setattr(structure, "MOST", 5)  # larger traces go by joins
    assert sorted(map(tuple, structure.class_table(parts, 4).collect())) == want
    assert len({h for h, _, _ in want}) < len(want) == 120


def test_a_trace_of_many_batches_is_one_row(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = frame(spark, [s for t in range(9) for s in (span(f"t{t}", "0", None, "X"), *[span(f"t{t}", str(i), "0", "Y") for i in range(1, 10 + t % 2)])])
        rows = structure.class_table([df], 2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 9 and len({r.structure_hash for r in rows}) == 2
    assert sorted(map(tuple, rows)) == sorted(map(tuple, structure.structure_hashes(df, 2).collect()))


def test_parts_hold_each_trace_once(spark):
    whole = order_spans(spark, SF).drop("attributes")
    parts = [order_spans(spark, SF, k, 4).drop("attributes") for k in range(4)]
    assert sorted(map(str, whole.collect())) == sorted(str(r) for p in parts for r in p.collect())
    assert all(p.select("trace_id").distinct().count() > 0 for p in parts)


def test_hashing_shuffles_once(spark):
    df = frame(spark, forest())
    assert structure.hashes_by_trace(df, 4)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


@pytest.mark.parametrize("name", ["structure_hash", "exemplars", "class_sizes", "class_pattern", "class_orphans"])
def test_nothing_is_shuffled_by_levels_any_more(spark, name):
    """Each part's shuffle files go before the next part; what is left over is over the written classes."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and plan.count("Exchange") <= 1


def test_search_by_classes_reads_no_other_spans(spark):
    df = frame(spark, forest())
    hashes = structure.class_table([df], 4)
    for p in PATTERNS:
        assert sorted(map(tuple, search(df, p, hashes=hashes).collect())) == sorted(map(tuple, search(df, p).collect()))
    p = PATTERNS[2]  # the pattern's four nodes twice, the exemplars' classes three times
    assert search(df, p, hashes=hashes)._jdf.queryExecution().analyzed().collectLeaves().size() <= 11
