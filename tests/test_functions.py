from pyspark.sql import functions as F

from tracelattice.functions import scalars as S
from tracelattice.operators.indices.ranges import split_node
from tracelattice.sources.text import any_trace


def test_time_prefixes():
    assert S.time_prefixes(1651696900, 1651697000) == ["1651696", "1651697"]
    assert S.time_prefixes(1651691111, 1651697000) == [f"165169{i}" for i in range(1, 8)]


def test_node_arithmetic():
    assert S.parent_node(40, 50, 10) == (0, 100)
    assert S.parent_node(140, 150, 10) == (100, 200)
    assert S.parent_node(200, 300, 10) == (0, 1000)
    assert S.nearest_node((0, 100), 10, 0, 10) == (0, 10)
    assert S.nearest_node((0, 100), 10, 0, 90) == (0, 100)
    assert S.nearest_node((0, 1000), 10, 10, 90) == (0, 100)


def test_split_node():
    assert split_node([5], 10) == [[0]]
    parts = split_node([7] * 1000, 100)
    assert [i for p in parts for i in p] == list(range(1000)) and all(7 * len(p) <= 100 for p in parts)


def test_text_functions(spark):
    df = spark.createDataFrame([("abcd:efg:hi\n", "12-34-56", "a/12-34-56", "xyy"), (None, "bad", "bad", None)], "t string, b string, o string, s string")
    lo, hi = S.batch_bounds(F.col("b"))
    got = df.select(S.split_tokens(F.col("t"), ":"), lo, hi, S.batch_of_object(F.col("o")), S.strip_last(F.col("s"), "y")).collect()
    assert tuple(got[0]) == (["abcd", "efg", "hi"], 34, 56, "12-34-56", "xy")
    assert tuple(got[1]) == (None, None, None, None, None)


def test_property_text(spark):
    got = spark.range(1).select(S.as_text(F.lit(1.5), "double"), S.as_text(F.lit(True), "bool"), S.as_text(F.unhex(F.lit("0A")), "bytes"), S.seconds(F.lit(1_999_999_999))).first()
    assert tuple(got) == ("1.500000", "true", "0a", 1)


def test_any_trace(spark):
    rows = [("b2", "t1", "s1"), ("b1", "t3", "s2"), ("b1", "t2", "s3"), ("b1", "t2", "s3"), (None, None, None)]
    edges = spark.createDataFrame(rows, "batch string, trace_id string, span_id string")
    assert [r["span_id"] for r in any_trace(edges, ["t1", "t2", "t9"]).collect()] == ["s3", "s3"]
    assert any_trace(edges, ["t9"]).count() == 0
    assert any_trace(edges.limit(0), ["t1"]).count() == 0


def test_names_and_progress(spark):
    got = spark.range(1).select(S.replace_all(F.lit("aXbX"), "X", "XX"), S.replace_all(F.lit("a"), "", "b"), S.index_folder(F.lit("http.status.code")), *[S.is_spans_folder(F.lit(x)) for x in ("frontend", "index-k", "dyntraces-1", "tracehashes", "my-index-k")]).first()
    assert tuple(got) == ("aXXbXX", "a", "index-http-status-code", True, False, False, False, True)
    assert S.progress_text(0.5, "done", 10) == " [=====>    ] 50% done" and S.progress_text(1.0, "x", 4) == " [====] 100% x"
    assert [S.literal_text(x) for x in (True, 0.5, 7, b"\x0a", "t")] == ["true", "0.500000", "7", "0a", "t"]
