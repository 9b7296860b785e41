import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tracelattice.model import ANY_SERVICE, SPAN_SCHEMA, Compare, Condition, Returning, TracePattern, Window
from tracelattice.operators import batches as B
from tracelattice.operators import counts, structure
from tracelattice.operators.pattern import match, matching_traces
from tracelattice.operators.predicates import predicate
from tracelattice.plans.planner import search


def span(trace, span_id, parent, service, start=0, end=10, attributes=(), batch="00-0-99"):
    return batch, trace, span_id, parent, service, service, start * 10**9, end * 10**9, [dict(zip(("key", "type", "value"), a)) for a in attributes]


def frame(spark, rows):
    return spark.createDataFrame(rows, SPAN_SCHEMA)


def brute(rows, p, induced=True):
    out = []
    traces = {}
    for r in rows:
        traces.setdefault((r[0], r[1]), []).append(r)
    for key, spans in traces.items():
        parent = {s[2]: s[3] for s in spans}
        for pick in permutations(spans, len(p.nodes)):
            at = dict(zip(sorted(p.nodes), pick))
            if any(p.nodes[i] not in (ANY_SERVICE, at[i][4]) for i in at):
                continue
            ok = all((parent[at[y][2]] == at[x][2]) == ((x, y) in p.edges) for x in at for y in at if x != y and (induced or (x, y) in p.edges))
            if ok:
                out.append((*key, *(at[i][2] for i in sorted(at))))
    return sorted(out)


PATTERNS = [
    TracePattern({0: "X", 1: "Y"}, [(0, 1)]),
    TracePattern({0: "X", 1: "Y", 2: "Y"}, [(0, 1), (0, 2)]),
    TracePattern({0: "X", 1: "Y", 2: "Z", 3: "X"}, [(0, 1), (1, 2), (2, 3)]),
    TracePattern({0: ANY_SERVICE, 1: "Y", 2: ANY_SERVICE}, [(0, 1), (1, 2)]),
    TracePattern({0: "X", 1: "Y"}),
    TracePattern({0: "X"}),
]


@pytest.mark.parametrize("k", range(len(PATTERNS)))
def test_random_forests_agree_with_permutations(spark, k):
    p, r, rows = PATTERNS[k], random.Random(7), []
    for t in range(12):
        for i in range(r.randint(1, 6)):
            parent = None if i == 0 else r.choice([f"{t}.{j}" for j in range(i)] + ["gone"])
            rows.append(span(f"t{t}", f"{t}.{i}", parent, r.choice("XYZ")))
    df = frame(spark, rows)
    want = brute(rows, p)
    got = sorted(tuple(x[c] for c in ("batch", "trace_id", *(f"n{i}_span_id" for i in sorted(p.nodes)))) for x in match(df, p).collect())
    assert got == want
    assert sorted(map(tuple, matching_traces(df, p).collect())) == sorted({w[:2] for w in want})
    hashes = structure.structure_hashes(df, 7)
    assert sorted(map(tuple, structure.traces_by_class(df, hashes, p).collect())) == sorted({w[:2] for w in want})
    assert hashes.count() == 12


def test_labels_are_whole_names_and_patterns_fit(spark):
    df = frame(spark, [span("t", "1", None, "AB"), span("t", "2", "1", "Y")])
    assert search(df, TracePattern({0: "A", 1: "Y"}, [(0, 1)])).count() == 0
    assert search(df, TracePattern({0: "AB", 1: "Y", 2: "Y"}, [(0, 1), (0, 2)])).count() == 0
    assert search(df, TracePattern({})).count() == 0
    assert search(df, TracePattern({0: "AB"}), Window(5, 1)).count() == 0


def test_conditions_bind_to_the_mapped_span(spark):
    rows = [span("t", "1", None, "X"), span("t", "2", "1", "Y", 0, 5), span("t", "3", "2", "Y", 0, 50)]
    df, p = frame(spark, rows), TracePattern({0: "X", 1: "Y"}, [(0, 1)])
    slow = Condition(1, "latency", Compare.GT, 20 * 10**9)
    assert search(df, p, conditions=[slow]).count() == 0
    assert search(df, p, conditions=[slow], binding="service").count() == 1


def test_attribute_predicates(spark):
    rows = [span("t", "1", None, "X", attributes=[("k", "string", "9"), ("k", "string", "1")]), span("t", "2", "1", "X", 9, 1)]
    df = frame(spark, rows)
    count = lambda c: df.where(predicate(c)).count()
    assert count(Condition(0, "attr:k", Compare.GT, 100)) == 1  # text order, first value
    assert count(Condition(0, "attr:k", Compare.EQ, 1)) == 0
    assert count(Condition(0, "attr:none", Compare.LT, 1)) == 0
    assert count(Condition(0, "latency", Compare.LT, 0)) == 1  # ends before it starts


def test_returned_property_is_a_bag(spark):
    df = frame(spark, [span("t", "1", None, "X"), span("t", "2", "1", "Y"), span("t", "3", "1", "Y")])
    p = TracePattern({0: "X", 1: "Y"}, [(0, 1)])
    assert [r.value for r in search(df, p, returning=Returning(0, "service")).collect()] == ["X", "X"]


def test_windows_include_their_bounds(spark):
    rows = [span("a", "1", None, "X", 0, 10, batch="00-0-10"), span("b", "1", None, "X", 11, 20, batch="00-11-20"), span("c", "1", None, "X", 21, 30, batch="00-21-30")]
    df, p = frame(spark, rows), TracePattern({0: "X"})
    assert sorted(r.trace_id for r in search(df, p, Window(10, 11)).collect()) == ["a", "b"]
    assert sorted(r.trace_id for r in search(df, p, Window(12, 13)).collect()) == ["b"]
    assert [r.batch for r in B.batches(df).where(B.boundary(F.col("start_s"), F.col("end_s"), Window(12, 30))).collect()] == ["00-11-20"]


def test_counts(spark):
    df = frame(spark, [span("t", "1", None, "X"), span("t", "2", "1", "X"), span("u", "1", None, "X")])
    assert tuple(counts.traces_and_spans(df).first()) == (2, 2)  # distinct ids: both traces have a span "1"
    assert tuple(counts.traces_and_spans(df.limit(0)).first()) == (0, 0)


def test_object_sizes_by_bucket(spark, tmp_path):
    for name, data in (("a/x", b"12"), ("a/deep/y", b"345"), ("b/z", b"7"), ("b/empty", b""), ("top", b"6")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.bucket: (r.n_objects, r.n_bytes) for r in counts.object_sizes(spark, str(tmp_path)).collect()}
    assert got == {"a": (2, 5), "b": (1, 1), "": (1, 1), None: (4, 7)}


def test_typed_attribute_literals(spark):
    rows = [span("t", "1", None, "X", attributes=[("f", "bool", "true"), ("d", "double", "0.500000"), ("i", "int", "7")])]
    df = frame(spark, rows)
    for key, value, n in (("f", True, 1), ("f", False, 0), ("d", 0.5, 1), ("i", 7, 1), ("i", "7", 1)):
        assert search(df, TracePattern({0: "X"}), conditions=[Condition(0, f"attr:{key}", Compare.EQ, value)]).count() == n


def test_a_missing_text_is_returned_as_empty(spark):
    df = frame(spark, [span("t", "1", None, "X", attributes=[("k", "string", "v")]), span("u", "1", None, "X")])
    for prop, want in (("attr:k", ["", "v"]), ("parent_span_id", ["", ""]), ("latency", [10**10] * 2)):
        assert sorted(r.value for r in search(df, TracePattern({0: "X"}), returning=Returning(0, prop)).collect()) == want
    assert search(df, TracePattern({}), returning=Returning(0, "latency")).schema["value"].dataType.simpleString() == "bigint"


def test_odd_traces_are_classes_of_their_own(spark):
    ring = lambda t, last: [span(t, "1", "2", "X"), span(t, "2", "1", last)]
    twice = lambda t, last: [span(t, "1", None, "X"), span(t, "2", "1", "Y"), span(t, "2", "1", last)]
    pair = lambda t, a, b: [span(t, "1", "gone", a), span(t, "2", "lost", b)]
    rows = [*ring("a", "Y"), *ring("b", "Z"), *twice("c", "Y"), *twice("d", "Z"), *pair("e", "X", "Y"), *pair("f", "Y", "X"), *pair("g", "X", "Z"), span("h", "1", "1", "X"), *[span("i", str(k), None, None) for k in range(2)]]
    df = frame(spark, rows)
    hashes = structure.structure_hashes(df, 4)
    of = {r.trace_id: r.structure_hash for r in hashes.collect()}
    assert len(of) == 9 and of["e"] == of["f"] and len(set(of.values())) == 8
    for p in (*PATTERNS, TracePattern({0: ANY_SERVICE, 1: ANY_SERVICE}), TracePattern({0: "Z"})):
        plain = sorted(map(tuple, search(df, p).collect()))
        assert sorted(map(tuple, search(df, p, hashes=hashes).collect())) == plain
        assert sorted(map(tuple, search(df, p, hashes=hashes.where("trace_id < 'e'")).collect())) == plain


def test_rarest_label_first(spark):
    from tracelattice.operators.pattern import placement
    from tracelattice.plans.planner import label_counts

    df = frame(spark, [span("t", "1", None, "X"), span("t", "2", "1", "X"), span("t", "3", "2", "Y")])
    p = TracePattern({0: "X", 1: "X", 2: "Y"}, [(0, 1), (1, 2)])
    found = label_counts(df, p)
    assert found == {"X": 2, "Y": 1} and placement(p, found) == [2, 1, 0]
    assert search(df, p, counts=found).count() == search(df, p).count() == 1


def test_traces_deeper_than_their_hash_are_matched_by_themselves(spark):
    chain = lambda t, n, last: [span(t, f"{t}.{i}", f"{t}.{i - 1}" if i else None, last if i == n - 1 else "X") for i in range(n)]
    df = frame(spark, chain("a", 12, "Y") + chain("b", 12, "Z") + chain("c", 12, "Y") + chain("d", 3, "Y") + chain("e", 3, "Y") + chain("f", 8, "Y") + chain("g", 8, "Y"))
    hashes = structure.structure_hashes(df, 8)
    for label, want in (("Y", "acdefg"), ("Z", "b")):
        p = TracePattern({0: "X", 1: label}, [(0, 1)])
        assert sorted(r.trace_id for r in structure.traces_by_class(df, hashes, p).collect()) == list(want)
        assert sorted(r.trace_id for r in search(df, p, hashes=hashes).collect()) == list(want)
    of = {r.trace_id: r.structure_hash for r in hashes.collect()}
    assert of["d"] == of["e"] and of["f"] == of["g"] and len(set(of.values())) == 5
