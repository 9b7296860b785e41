import random
import struct

import pytest
from pyspark.sql import functions as F
from tests.test_pattern import frame, span

from tracelattice import scratch
from tracelattice.functions import scalars as S
from tracelattice.model import ANY_SERVICE, Compare, Condition, IndexKind, TracePattern, Window
from tracelattice.operators import structure
from tracelattice.operators.indices import bloom, inverted, ranges, upkeep
from tracelattice.operators.indices.catalog import Catalog
from tracelattice.plans.planner import search
from tracelattice.sources import text
from tracelattice.sources.otlp import decode_otlp, encode_otlp, read_otlp
from tracelattice.streaming.maintain import compact, maintain, read_index


def rows(n=40):
    return [span(f"t{i}", f"{i}", None, "X", i * 100, i * 100 + i, [("k", "string", f"v-/{i % 5}"), ("k", "string", "all")], batch=f"{i % 4:02d}-{i // 4 * 400}-{i // 4 * 400 + 399}") for i in range(n)]


def test_inverted_indexes_every_value(spark, tmp_path):
    df = frame(spark, rows())
    inverted.write(inverted.build(df), str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    assert {r.trace_id for r in inverted.probe(index, "k", "v-/3").collect()} == {f"t{i}" for i in range(3, 40, 5)}
    assert inverted.probe(index, "k", "all").count() == 40


def test_range_orders_numbers(spark):
    index = ranges.build(frame(spark, rows()), "latency")
    found = lambda **k: {r.trace_id for r in ranges.probe(index, "latency", Compare.GT, str(9 * 10**9), **k).collect()}
    assert found() == {f"t{i}" for i in range(10, 40)}
    assert found(lexical=True) == set()


def test_bloom_misses_nothing(spark):
    df = frame(spark, rows())
    nodes = scratch.materialise(bloom.build(df, "trace_id", 800, 2, 3, n=20, fpp=0.01), "bloom")
    for i in (0, 7, 20, 39):
        assert bloom.verify(df, bloom.probe(nodes, f"t{i}", 3, n=20, fpp=0.01), "trace_id", f"t{i}").count() == 1
    assert bloom.verify(df, bloom.probe(nodes, "none", 3, n=20, fpp=0.01), "trace_id", "none").count() == 0


def forest(seed):
    """Random traces with orphans, batches of any name, large numbers, and attributes of all types."""
    r, out = random.Random(seed), []
    names = [f"{i:02d}-{i * 400}-{i * 400 + 399}" for i in range(8)] + ["odd", "a-b-c", "00-12"]
    for t in range(30):
        batch = r.choice(names)
        base = 1670796531_000_000_000 + r.randint(0, 3)
        for i in range(r.randint(1, 5)):
            parent = None if i == 0 else r.choice([f"{t}.{j}" for j in range(i)] + ["gone"])
            attributes = [{"key": k, "type": kind, "value": v} for k, kind, v in (("s", "string", r.choice("abc")), ("f", "bool", r.choice(("true", "false"))), ("d", "double", f"{r.choice((0.5, 2.0)):.6f}")) if r.random() < 0.8]
            start = base + r.randint(0, 2)
            out.append((batch, f"t{t}", f"{t}.{i}", parent, r.choice("XYZ"), r.choice(("call", "cast")), start, start + r.choice((1, 9, 10, 100)), attributes))
    return out


CONDITIONS = [
    Condition(0, "attr:s", Compare.EQ, "a"), Condition(1, "attr:f", Compare.EQ, True), Condition(0, "attr:d", Compare.GT, 0.5), Condition(1, "latency", Compare.GT, 9), Condition(0, "latency", Compare.EQ, 10.0),
    Condition(0, "start_ns", Compare.GT, 1670796531_000_000_001), Condition(1, "start_ns", Compare.EQ, 1670796531_000_000_002), Condition(1, "name", Compare.LT, "cast"), Condition(0, "service", Compare.EQ, "X"), Condition(0, "latency", Compare.LT, 9.5),
    Condition(1, "span_id", Compare.EQ, "3.1"),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_indexes_and_classes_never_change_a_result(spark, seed):
    r, df = random.Random(seed), frame(spark, forest(seed)).cache()
    catalog, hashes = Catalog(spark), structure.structure_hashes(df, 3).cache()
    for prop in ("attr:s", "attr:f", "attr:d", "latency", "start_ns", "name", "service", "span_id"):
        kinds = [IndexKind.RANGE, IndexKind.BLOOM] + [IndexKind.INVERTED] * prop.startswith("attr:")
        kind = r.choice(kinds)
        for until in sorted(r.sample((400, 1200, 2800), r.randint(1, 2))):
            upkeep.update(df, catalog, prop, kind, until, **({"granularity": 400, "fan": 3, "levels": 3, "n": 5, "fpp": 0.2} if kind is IndexKind.BLOOM else {}))
    used = 0
    for _ in range(5):
        p = r.choice((TracePattern({0: "X", 1: "Y"}, [(0, 1)]), TracePattern({0: ANY_SERVICE, 1: ANY_SERVICE}, [(0, 1)]), TracePattern({0: "X", 1: ANY_SERVICE})))
        conditions, w = r.sample(CONDITIONS, r.randint(1, 3)), r.choice((None, None, Window(0, 2_000_000_000)))
        used += any(catalog.find(c) for c in conditions)
        how = {"binding": r.choice(("span", "service"))}
        want = sorted(map(tuple, search(df, p, w, conditions, **how).collect()))
        assert sorted(map(tuple, search(df, p, w, conditions, catalog=catalog, **how).collect())) == want, (p, conditions)
        assert sorted(map(tuple, search(df, p, w, conditions, catalog=catalog, hashes=hashes, **how).collect())) == want, (p, conditions)
    assert used


def test_relations_grow_by_a_constant_for_each_index(spark):
    df, catalog = frame(spark, rows()), Catalog(spark)
    props = ["latency", "start_ns", "end_ns"]
    for prop in props:
        upkeep.update(df, catalog, prop, IndexKind.RANGE, 10_000)
    p = TracePattern({0: "X", 1: "X", 2: "X"}, [(0, 1), (1, 2)])
    conditions = [Condition(0, prop, Compare.GT, 5) for prop in props]
    sizes = [search(df, p, conditions=conditions[:k], catalog=catalog)._jdf.queryExecution().analyzed().collectLeaves().size() for k in range(4)]
    assert sizes == [3, 4, 5, 6]  # the pattern's three nodes, and each index once


def test_updates_equal_a_full_build(spark):
    df = frame(spark, rows())
    for kind, prop, keep in ((IndexKind.INVERTED, "attr:k", {}), (IndexKind.RANGE, "latency", {}), (IndexKind.BLOOM, "trace_id", {"granularity": 800, "fan": 2, "levels": 3, "n": 20, "fpp": 0.01})):
        steps, once = Catalog(spark), Catalog(spark)
        for until in (0, 800, 800, 700, 4000):
            upkeep.update(df, steps, prop, kind, until, **keep)
        upkeep.update(df, once, prop, kind, 4000, **keep)
        a, b = steps.entry(prop, kind), once.entry(prop, kind)
        assert a.last_updated == 4000 and a.params == b.params and steps.earliest() == 4000
        read = [bloom.compact(upkeep.read(df, e)) if kind is IndexKind.BLOOM else upkeep.read(df, e).drop("run") for e in (a, b)]
        assert sorted(map(str, read[0].collect())) == sorted(map(str, read[1].collect())) and read[0].count() > 0
        assert upkeep.read(df, a).select("run").distinct().count() == 3


def test_a_bloom_index_is_sized_by_its_fullest_filter(spark):
    df, catalog = frame(spark, [span(f"t{i}", f"{i}", None, "X", batch="00-0-99") for i in range(1500)]), Catalog(spark)
    e = upkeep.update(df, catalog, "trace_id", IndexKind.BLOOM, 99)
    assert e.params["n"] == 2048 and S.effective_fpp(*S.bloom_size(2048, 1e-4), 2048) < 1.1e-4 < S.effective_fpp(*S.bloom_size(2048, 1e-4), 9000)
    assert search(df, TracePattern({0: "X"}), conditions=[Condition(0, "trace_id", Compare.EQ, "t77")], catalog=catalog).count() == 1


def test_what_reads_back_differently_is_an_error(spark, tmp_path):
    df = frame(spark, rows()).select(*[f.split()[0] for f in "batch trace_id".split()])
    upkeep.save_checked(df, lambda d, path: d.write.parquet(path), str(tmp_path / "a"), "batch string, trace_id string")
    with pytest.raises(OSError, match="differently"):
        upkeep.save_checked(df, lambda d, path: (d.write.parquet(path), d.limit(3).write.mode("overwrite").parquet(path)), str(tmp_path / "b"), "batch string, trace_id string")


def test_bitmaps_combine(spark):
    bits = lambda *rows: spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "k int, bits binary")
    for how, want in (("and", {1: b"\x04", 2: b"\x00", 3: b"\x00"}), ("or", {1: b"\x07", 2: b"\x01", 3: b"\xff"}), ("xor", {1: b"\x03", 2: b"\x01", 3: b"\xff"})):
        got = bloom.combine(bits((1, b"\x05"), (2, b"\x01")), bits((1, b"\x06"), (3, b"\xff")), how, ["k"]).collect()
        assert {r.k: bytes(r.bits) for r in got} == want


def test_stream_equals_batch(spark, tmp_path):
    df = frame(spark, rows())
    for k in range(3):
        df.where(f"start_ns % 3 = {k} or trace_id = 't1'").write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        maintain(stream, inverted.build, str(tmp_path / "index"), str(tmp_path / "checkpoint"))
    want = sorted(map(tuple, inverted.build(df).collect()))
    assert sorted(map(tuple, read_index(spark, str(tmp_path / "index")).collect())) == want
    compact(spark, str(tmp_path / "index"), str(tmp_path / "one"))
    assert sorted(map(tuple, read_index(spark, str(tmp_path / "one")).collect())) == want


def test_text_round_trip_keeps_the_last_trace(spark, tmp_path):
    df = frame(spark, [span("0" * 31 + str(i), str(j), None if j == 0 else "0", f"s{j}") for i in range(3) for j in range(3)])
    text.to_blocks(df).select("value").coalesce(1).write.option("lineSep", "\n").text(str(tmp_path / "t"))
    got = text.read_edges(spark, str(tmp_path / "t/*.txt"))
    assert sorted(map(tuple, got.select("trace_id", "parent_span_id", "span_id", "service").collect()), key=str) == sorted(map(tuple, df.select("trace_id", "parent_span_id", "span_id", "service").collect()), key=str)


def message(*parts):
    out = b""
    for number, kind, value in parts:
        out += bytes([number << 3 | kind])
        out += bytes([len(value)]) + value if kind == 2 else value
    return out


def test_otlp_files(spark, tmp_path):
    attribute = message((1, 2, b"n"), (2, 2, message((3, 0, b"\x07"))))
    odd = message((1, 2, b"o"), (2, 2, message((5, 2, b""))), (9, 5, bytes(4)))
    raw = message((1, 2, b"r"), (2, 2, message((7, 2, b"\x00\xff"))))
    one = message((1, 2, bytes(15) + b"\x01"), (2, 2, bytes(7) + b"\x02"), (5, 2, b"call"), (7, 1, struct.pack("<q", 5)), (8, 1, struct.pack("<q", 9)), (9, 2, attribute), (9, 2, odd), (9, 2, raw))
    data = message((1, 2, message((2, 2, message((2, 2, one))))))
    (tmp_path / "svc").mkdir()
    (tmp_path / "svc/00-0-9").write_bytes(data)
    (tmp_path / "svc/00-10-19").write_bytes(b"")
    r = read_otlp(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].service == "svc" and r[0].batch == "00-0-9" and r[0].trace_id == "0" * 31 + "1" and r[0].parent_span_id is None
    assert (r[0].start_ns, r[0].end_ns) == (5, 9) and [tuple(a) for a in r[0].attributes] == [("n", "int", "7"), ("o", "array", None), ("r", "bytes", "00ff")]


def test_otlp_round_trip_of_all_types(spark):
    values = [("s", "string", "é"), ("b", "bool", "true"), ("f", "bool", "false"), ("i", "int", "-9223372036854775808"), ("d", "double", "0.250000"), ("x", "bytes", "00ff")]
    rows = [span(f"{i:032x}", f"{i:016x}", None if i % 3 == 0 else f"{i - 1:016x}", f"svc{i % 2}", i, i + 1, values if i % 2 else (), batch=f"00-{i % 4}-9") for i in range(1, 60)]
    df = frame(spark, rows)
    assert sorted(map(str, decode_otlp(encode_otlp(df, per_message=3)).collect())) == sorted(map(str, df.collect()))
    assert encode_otlp(df, per_message=3).count() > 8 and decode_otlp(encode_otlp(df.limit(0))).count() == 0


def test_damaged_otlp_fails(spark):
    for content in (b"\x0a", b"\x0a\x05abc", b"\x0b", b"\x08\xff"):
        with pytest.raises(Exception, match="ValueError"):
            decode_otlp(spark.createDataFrame([(bytearray(content), "b", "s")], "content binary, batch string, folder string")).collect()


def test_stored_spans_join_without_a_shuffle(spark, tmp_path):
    from tracelattice.operators.pattern import match
    from tracelattice.session import configure
    from tracelattice.sources.derived import read_spans, save_spans, write_spans

    df = frame(spark, rows() + [span(f"t{i}", f"c{i}", f"{i}", "Y", batch=f"{i % 4:02d}-{i // 4 * 400}-{i // 4 * 400 + 399}") for i in range(40)])
    p = TracePattern({0: "X", 1: "Y"}, [(0, 1)])
    spark.sql("drop table if exists spans_test")
    stored = save_spans(df, "spans_test", 4)
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        configure(spark)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = match(stored, p)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 40
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", before)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("drop table if exists spans_test")
    write_spans(df, str(tmp_path / "s"))
    assert match(read_spans(spark, str(tmp_path / "s")), p).count() == 40
