"""Named queries over the derived spans, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelattice import scratch
from tracelattice.functions.scalars import as_text, batch_of_object, floor_to, index_folder, is_spans_folder, latency, replace_all, seconds, split_tokens, strip_last, time_prefixes
from tracelattice.model import ANY_SERVICE, Compare, Condition, IndexKind, Returning, TracePattern, Window
from tracelattice.operators import batches as B
from tracelattice.operators import counts, structure
from tracelattice.operators.indices import bloom, inverted, ranges, upkeep
from tracelattice.operators.indices.catalog import Catalog, intersect
from tracelattice.operators.pattern import match
from tracelattice.operators.predicates import predicate
from tracelattice.plans.planner import label_counts, search
from tracelattice.session import dropping_shuffles
from tracelattice.sources import text
from tracelattice.sources.derived import chain_spans, order_spans, table
from tracelattice.sources.otlp import decode_otlp, encode_otlp
from tracelattice.streaming.maintain import maintain, read_index

ONE_CALL = TracePattern({0: "order.F", 1: "line.AF"}, [(0, 1)])
FANOUT = TracePattern({0: "order.F", 1: "line.AF", 2: "line.AF", 3: "line.RO", 4: "line.NO"}, [(0, 1), (0, 2), (0, 3), (0, 4)])
HEIGHT = TracePattern({0: "order.F", 1: "line.AF", 2: "part.PROMO", 3: "supp.ASIA"}, [(0, 1), (1, 2), (2, 3)])
DURATION = TracePattern({0: "order.F", 1: "line.AF", 2: "line.RO"}, [(0, 1), (0, 2)])
CANONICAL = TracePattern({0: "order.F", 1: "line.AF", 2: "line.AF"}, [(0, 1), (0, 2)])
WILDCARD = TracePattern({0: ANY_SERVICE, 1: "line.AF", 2: "part.PROMO"}, [(0, 1), (1, 2)])
FOREST = TracePattern({0: "line.AF", 1: "part.PROMO"})
SLOW_ROOT = Condition(0, "latency", Compare.LT, 10_000_000_000)
YEAR = Window(852076800, 883612799)
CHAIN = TracePattern({0: "user", 1: "assistant", 2: "user"}, [(0, 1), (1, 2)])

SPANS_SQL = """
WITH l AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS seq
  FROM lineitem),
o AS (
  SELECT *, epoch_us(o_orderdate) AS us, (epoch_us(o_orderdate) // 1000000) // 2592000 AS b FROM orders),
lev AS (
  SELECT o_orderkey AS k, 0 AS seq, 0 AS lv, us, b, 'order.' || o_orderstatus AS service, o_totalprice AS amount,
         'priority' AS attr_key, o_orderpriority AS attr_value FROM o
  UNION ALL SELECT o_orderkey, seq, 1, us, b, 'line.' || l_returnflag || l_linestatus, l_extendedprice, 'http.status_code',
         CAST(200 + (CAST(l_quantity AS BIGINT) % 4) * 100 AS VARCHAR) FROM o JOIN l ON o_orderkey = l_orderkey
  UNION ALL SELECT o_orderkey, seq, 2, us, b, 'part.' || p_type, p_retailprice, 'brand', p_brand
         FROM o JOIN l ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT o_orderkey, seq, 3, us, b, 'supp.' || r_name, abs(s_acctbal), 'nation', n_name
         FROM o JOIN l ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey
         JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
spans AS MATERIALIZED (
  SELECT lpad(CAST(b % 100 AS VARCHAR), 2, '0') || '-' || CAST(b * 2592000 AS VARCHAR) || '-' || CAST(b * 2592000 + 2591999 AS VARCHAR) AS batch,
         b * 2592000 AS b_start, b * 2592000 + 2591999 AS b_end,
         printf('%032x', k) AS trace_id, printf('%016x', k * 1000 + seq * 10 + lv) AS span_id,
         CASE lv WHEN 0 THEN NULL WHEN 1 THEN printf('%016x', k * 1000) ELSE printf('%016x', k * 1000 + seq * 10 + lv - 1) END AS parent_span_id,
         service, us * 1000 + lv * 1000000 AS start_ns, us * 1000 + lv * 1000000 + CAST(floor(amount * 100 + 0.5) AS BIGINT) * 1000 AS end_ns,
         attr_key, attr_value, lv
  FROM lev)
"""
CHAIN_SQL = """
WITH spans AS MATERIALIZED (
  SELECT '00-0-99999' AS batch, printf('%032x', conv_id) AS trace_id, printf('%016x', conv_id * 1000 + turn) AS span_id,
         CASE WHEN turn > min(turn) OVER (PARTITION BY conv_id) THEN printf('%016x', conv_id * 1000 + turn - 1) END AS parent_span_id, role AS service
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
"""

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, run: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """Register a query over the order spans."""
    QUERIES[name] = lambda spark, sf_dir: run(order_spans(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = SPANS_SQL + sql


def joined(nodes: dict[int, str], edges: list[tuple[int, int]], where: str = "") -> str:
    """FROM and WHERE of a pattern as self-joins, node by node."""
    out, placed = "FROM spans n0", [0]
    for i in list(nodes)[1:]:
        on = [f"n{i}.trace_id = n0.trace_id AND n{i}.batch = n0.batch"]
        on += [f"n{b}.parent_span_id = n{a}.span_id" for a, b in edges if i in (a, b) and {a, b} <= {*placed, i}]
        on += [f"n{i}.service = '{nodes[i]}'"] if nodes[i] != ANY_SERVICE else []
        on += [f"n{i}.span_id <> n{j}.span_id" for j in placed]
        out += f" JOIN spans n{i} ON {' AND '.join(on)}"
        placed.append(i)
    return f"{out} WHERE {'true' if nodes[0] == ANY_SERVICE else f"n0.service = '{nodes[0]}'"} {where}"


def traces_sql(p: TracePattern, where: str = "") -> str:
    return "SELECT DISTINCT n0.batch AS batch, n0.trace_id AS trace_id " + joined(p.nodes, p.edges, where)


for _name, _p in (("one_call", ONE_CALL), ("fanout", FANOUT), ("height", HEIGHT), ("canonical", CANONICAL), ("wildcard", WILDCARD)):
    add(f"pattern_{_name}", lambda s, p=_p: search(s, p), traces_sql(_p))
add(
    "pattern_isomap_count",
    lambda s: match(s, CANONICAL).groupBy("trace_id").agg(F.count("*").alias("n_mappings")),
    "SELECT n0.trace_id AS trace_id, count(*) AS n_mappings " + joined(CANONICAL.nodes, CANONICAL.edges) + " GROUP BY 1",
)
add(
    "pattern_forest_induced",
    lambda s: search(s, FOREST),
    traces_sql(FOREST, "AND n1.parent_span_id IS DISTINCT FROM n0.span_id AND n0.parent_span_id IS DISTINCT FROM n1.span_id"),
)
add("pattern_duration", lambda s: search(s, DURATION, conditions=[SLOW_ROOT]), traces_sql(DURATION, "AND n0.end_ns - n0.start_ns < 10000000000"))
SERVICE_BOUND = Condition(1, "latency", Compare.GT, 9_000_000_000)
add(
    "pattern_service_binding",
    lambda s: search(s, CANONICAL, conditions=[SERVICE_BOUND], binding="service"),
    traces_sql(CANONICAL, "AND EXISTS (SELECT 1 FROM spans x WHERE x.trace_id = n1.trace_id AND x.service = n1.service AND x.end_ns - x.start_ns > 9000000000)"),
)

_SPAN = "SELECT batch, trace_id, span_id FROM spans WHERE "
for _name, _c, _sql in (
    ("cond_attr_eq", Condition(0, "attr:brand", Compare.EQ, "Brand#12"), "attr_key = 'brand' AND attr_value = 'Brand#12'"),
    ("cond_attr_lt", Condition(0, "attr:http.status_code", Compare.LT, "300"), "attr_key = 'http.status_code' AND attr_value < '300'"),
    ("cond_attr_gt", Condition(0, "attr:http.status_code", Compare.GT, "40"), "attr_key = 'http.status_code' AND attr_value > '40'"),
    ("cond_latency", Condition(0, "latency", Compare.GT, 40_000_000_000), "end_ns - start_ns > 40000000000"),
    ("cond_start_time", Condition(0, "start_ns", Compare.LT, 800_000_000_000_000_000), "start_ns < 800000000000000000"),
    ("cond_end_time", Condition(0, "end_ns", Compare.GT, 890_000_000_000_000_000), "end_ns > 890000000000000000"),
    ("cond_bytes_eq", Condition(0, "span_id", Compare.EQ, "00000000000003e8"), "span_id = '00000000000003e8'"),
    ("cond_bytes_lt", Condition(0, "span_id", Compare.LT, "00000000000003ef"), "span_id < '00000000000003ef'"),
    ("cond_bytes_gt", Condition(0, "parent_span_id", Compare.GT, "0000000000e00000"), "parent_span_id > '0000000000e00000'"),
    ("cond_attr_int", Condition(0, "attr:http.status_code", Compare.EQ, 200), "attr_key = 'http.status_code' AND attr_value = '200'"),
    ("cond_string", Condition(0, "service", Compare.LT, "line.B"), "service < 'line.B'"),
    ("cond_int", Condition(0, "start_s", Compare.LT, 800_000_000), "start_ns // 1000000000 < 800000000"),
):
    add(_name, lambda s, c=_c: s.where(predicate(c)).select("batch", "trace_id", "span_id"), _SPAN + _sql)
add(
    "cond_double",
    lambda s: s.withColumn("ms", (F.col("end_ns") - F.col("start_ns")) / F.lit(1e6)).where(predicate(Condition(0, "ms", Compare.GT, 40000.5))).select("batch", "trace_id", "span_id"),
    _SPAN + "(end_ns - start_ns) / 1e6 > 40000.5",
)
add(
    "cond_bool",
    lambda s: s.withColumn("is_root", F.col("parent_span_id").isNull()).where(predicate(Condition(0, "is_root", Compare.EQ, True))).select("batch", "trace_id", "span_id"),
    _SPAN + "parent_span_id IS NULL",
)
add(
    "return_property_multiset",
    lambda s: search(s, CANONICAL, returning=Returning(1, "service")).select("trace_id", F.col("value").alias("service")),
    "SELECT n0.trace_id AS trace_id, n1.service AS service " + joined(CANONICAL.nodes, CANONICAL.edges),
)
add(
    "return_latency",
    lambda s: search(s, HEIGHT, returning=Returning(3, "latency")).select("trace_id", F.col("value").cast("string").alias("latency")),
    "SELECT n0.trace_id AS trace_id, CAST(n3.end_ns - n3.start_ns AS VARCHAR) AS latency " + joined(HEIGHT.nodes, HEIGHT.edges),
)

add(
    "return_missing_text",
    lambda s: search(s, ONE_CALL, returning=Returning(1, "attr:brand")).select("trace_id", F.col("value").alias("brand")),
    "SELECT n0.trace_id AS trace_id, '' AS brand " + joined(ONE_CALL.nodes, ONE_CALL.edges),
)
add("pattern_rarest_first", lambda s: search(s, HEIGHT, counts=label_counts(s, HEIGHT)), traces_sql(HEIGHT))

# Batches and windows
_WIN = f"b_start <= {YEAR.end_s} AND b_end >= {YEAR.start_s}"
add("list_batches", lambda s: B.batches(s), "SELECT DISTINCT batch, b_start AS start_s, b_end AS end_s FROM spans")
add("window_batches", lambda s: B.batches(B.in_window(s, YEAR)), f"SELECT DISTINCT batch, b_start AS start_s, b_end AS end_s FROM spans WHERE {_WIN}")
add(
    "window_boundary",
    lambda s: B.batches(s).where(B.boundary(F.col("start_s"), F.col("end_s"), YEAR)).select("batch"),
    f"SELECT DISTINCT batch FROM spans WHERE {_WIN} AND (b_start < {YEAR.start_s} OR b_end > {YEAR.end_s})",
)
_IN = f"n0.start_ns // 1000000000 <= {YEAR.end_s} AND n0.end_ns // 1000000000 >= {YEAR.start_s}"
add(
    "window_traces",
    lambda s: B.traces_in_window(s, YEAR),
    f"SELECT batch, trace_id FROM spans n0 WHERE parent_span_id IS NULL AND {_IN}",
)
add("pattern_in_window", lambda s: search(s, ONE_CALL, YEAR), traces_sql(ONE_CALL, f"AND {_IN}"))
add(
    "window_prefixes",
    lambda s: B.batches(s).where(reduce(or_, [F.startswith(F.col("start_s").cast("string"), F.lit(p)) for p in time_prefixes(YEAR.start_s, YEAR.end_s)])).select("batch"),
    f"SELECT DISTINCT batch FROM spans WHERE b_start // 10000000 BETWEEN {YEAR.start_s // 10**7} AND {YEAR.end_s // 10**7}",
)
add("min_batch_start", lambda s: B.lowest_start(s), "SELECT min(b_start) AS min_start_s FROM spans")
add("list_services", lambda s: B.services(s), "SELECT DISTINCT service FROM spans")
add("root_service", lambda s: B.roots(s).select("trace_id", "service"), "SELECT trace_id, service FROM spans WHERE parent_span_id IS NULL")
add(
    "root_inverse",
    lambda s: B.traces_by_root_service(s),
    "SELECT service, count(*) AS n_traces, min(trace_id) AS first_trace FROM spans WHERE parent_span_id IS NULL GROUP BY 1",
)
add(
    "edges_parse",
    lambda s: text.parse_blocks(text.to_blocks(s)).select("trace_id", "parent_span_id", "span_id", "service"),
    "SELECT trace_id, parent_span_id, span_id, service FROM spans",
)
add(
    "hex_ids",
    lambda s: s.select(F.lower(F.hex(F.unhex("span_id"))).alias("span_hex"), F.conv("span_id", 16, 10).cast("bigint").alias("span_number")),
    "SELECT span_id AS span_hex, CAST('0x' || span_id AS BIGINT) AS span_number FROM spans",
)
add("ns_to_s", lambda s: s.select("span_id", seconds(F.col("start_ns")).alias("start_s")), "SELECT span_id, start_ns // 1000000000 AS start_s FROM spans")
add("list_batches_sorted", lambda s: B.batches(s).orderBy("start_s", "batch"), "SELECT DISTINCT batch, b_start AS start_s, b_end AS end_s FROM spans ORDER BY start_s, batch")
add(
    "root_times",
    lambda s: B.roots(s).select("batch", "trace_id", seconds(F.col("start_ns")).alias("start_s"), seconds(F.col("end_ns")).alias("end_s")),
    "SELECT batch, trace_id, start_ns // 1000000000 AS start_s, end_ns // 1000000000 AS end_s FROM spans WHERE parent_span_id IS NULL",
)
THREE = [f"{k:032x}" for k in (7, 1, (1 << 128) - 1)]
add(
    "text_any_trace",
    lambda s: text.any_trace(text.parse_blocks(text.to_blocks(s)), THREE).select("trace_id", "span_id", "service"),
    f"SELECT trace_id, span_id, service FROM spans WHERE trace_id = (SELECT min(struct_pack(batch := batch, trace_id := trace_id)).trace_id FROM spans WHERE trace_id IN ({', '.join(map(repr, THREE))}))",
)
add(
    "property_text",
    lambda s: s.select(
        as_text(F.unhex("span_id"), "bytes").alias("id_text"), as_text(F.col("parent_span_id").isNull(), "bool").alias("root_text"),
        as_text(latency(F.col("start_ns"), F.col("end_ns")) / F.lit(1e6), "double").alias("ms_text"), as_text(F.col("start_ns"), "int").alias("start_text"),
    ),
    "SELECT span_id AS id_text, CAST(parent_span_id IS NULL AS VARCHAR) AS root_text, printf('%.6f', (end_ns - start_ns) / 1e6) AS ms_text, CAST(start_ns AS VARCHAR) AS start_text FROM spans",
)
add(
    "batch_name_parts",
    lambda s: s.select("batch").distinct().select(
        batch_of_object(F.concat(F.lit("spans/"), "batch")).alias("batch"), F.get(split_tokens(F.concat("batch", F.lit("\n")), "-"), 2).alias("last"), strip_last(F.col("batch"), "9").alias("stripped")
    ),
    "SELECT DISTINCT batch, string_split(batch, '-')[3] AS last, CASE WHEN suffix(batch, '9') THEN left(batch, length(batch) - 1) ELSE batch END AS stripped FROM spans",
)
add(
    "time_buckets",
    lambda s: s.groupBy(floor_to(seconds(F.col("start_ns")), ranges.NODE_S).alias("node_start"), floor_to(seconds(F.col("start_ns")), ranges.NODE_S * ranges.NODES_PER_SUMMARY).alias("summary_start")).agg(F.count("*").alias("n_spans")),
    "SELECT x - x % 100 AS node_start, x - x % 500 AS summary_start, count(*) AS n_spans FROM (SELECT start_ns // 1000000000 AS x FROM spans) GROUP BY 1, 2",
)
add(
    "naming_helpers",
    lambda s: s.select(F.explode("attributes").alias("a"), "service").select(F.col("a.key").alias("key"), "service").distinct().select(
        index_folder(F.col("key")).alias("folder"), is_spans_folder(index_folder(F.col("key"))).alias("index_is_spans"), is_spans_folder(F.col("service")).alias("service_is_spans"), replace_all(F.col("service"), "r.", "::").alias("replaced")
    ),
    "SELECT DISTINCT 'index-' || replace(attr_key, '.', '-') AS folder, false AS index_is_spans, true AS service_is_spans, replace(service, 'r.', '::') AS replaced FROM (SELECT DISTINCT attr_key, service FROM spans)",
)
add(
    "otlp_round_trip",
    lambda s: decode_otlp(encode_otlp(s)).select(
        "batch", "trace_id", "span_id", "parent_span_id", "service", "name", "start_ns", "end_ns", F.col("attributes")[0]["key"].alias("attr_key"), F.col("attributes")[0]["type"].alias("attr_type"), F.col("attributes")[0]["value"].alias("attr_value")
    ),
    """SELECT batch, trace_id, span_id, parent_span_id, service, CASE lv WHEN 0 THEN 'order' WHEN 1 THEN 'line' WHEN 2 THEN 'part' ELSE 'supplier' END AS name, start_ns, end_ns, attr_key,
    CASE attr_key WHEN 'http.status_code' THEN 'int' ELSE 'string' END AS attr_type, attr_value FROM spans""",
)
add(
    "trace_text",
    structure.trace_text,
    """SELECT batch, trace_id, count(*) AS n_nodes, string_agg(span_id || ' : ' || service, ', ' ORDER BY span_id || ' : ' || service) AS node_names,
    coalesce(string_agg(parent_span_id || ' : ' || span_id, ', ' ORDER BY parent_span_id || ' : ' || span_id), '') AS edges FROM spans GROUP BY 1, 2""",
)
add("search_bad_window", lambda s: search(s, ONE_CALL, Window(YEAR.end_s, YEAR.start_s)), "SELECT batch, trace_id FROM spans WHERE false")
BY_ID = Condition(0, "trace_id", Compare.EQ, f"{367:032x}")
add("pattern_trace_id", lambda s: search(s, CANONICAL, conditions=[BY_ID]), traces_sql(CANONICAL, f"AND n0.trace_id = '{BY_ID.value}'"))
add(
    "return_span_id",
    lambda s: search(s, DURATION, returning=Returning(2, "span_id")).select("trace_id", F.col("value").alias("span_id")),
    "SELECT n0.trace_id AS trace_id, n2.span_id AS span_id " + joined(DURATION.nodes, DURATION.edges),
)

# Structural classes
_HASH_SQL = """,
h3 AS (SELECT *, md5(service || '()') AS h FROM spans),
c2 AS (SELECT batch, trace_id, parent_span_id AS p, string_agg(h, ',' ORDER BY h) AS k FROM h3 WHERE parent_span_id IS NOT NULL GROUP BY 1, 2, 3),
h2 AS (SELECT s.*, md5(service || '(' || coalesce(k, '') || ')') AS h FROM spans s LEFT JOIN c2 ON c2.trace_id = s.trace_id AND c2.p = s.span_id),
c1 AS (SELECT batch, trace_id, parent_span_id AS p, string_agg(h, ',' ORDER BY h) AS k FROM h2 WHERE parent_span_id IS NOT NULL GROUP BY 1, 2, 3),
h1 AS (SELECT s.*, md5(service || '(' || coalesce(k, '') || ')') AS h FROM spans s LEFT JOIN c1 ON c1.trace_id = s.trace_id AND c1.p = s.span_id),
c0 AS (SELECT batch, trace_id, parent_span_id AS p, string_agg(h, ',' ORDER BY h) AS k FROM h1 WHERE parent_span_id IS NOT NULL GROUP BY 1, 2, 3),
th AS (SELECT md5(service || '(' || coalesce(k, '') || ')') AS structure_hash, s.batch AS batch, s.trace_id AS trace_id
       FROM spans s LEFT JOIN c0 ON c0.trace_id = s.trace_id AND c0.p = s.span_id WHERE s.parent_span_id IS NULL)
"""


PARTS = 4  # fixed value: parts of the traces that are hashed one after another; disk is about that much less


def classes(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """The class table of the order spans (of those that ``where`` leaves), part by part."""
    return structure.class_table([order_spans(spark, sf_dir, k, PARTS).where(where) for k in range(PARTS)], 4)


def add_classes(name: str, run: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """Register a query over the class table of the order spans."""
    QUERIES[name] = lambda spark, sf_dir: run(classes(spark, sf_dir))
    ORACLES[name] = SPANS_SQL + sql


add_classes("structure_hash", lambda h: h, _HASH_SQL + "SELECT structure_hash, batch, trace_id FROM th")
add_classes(
    "exemplars",
    structure.exemplars,
    _HASH_SQL + "SELECT structure_hash, m.batch AS batch, m.trace_id AS trace_id FROM (SELECT structure_hash, min(struct_pack(batch := batch, trace_id := trace_id)) AS m FROM th GROUP BY 1)",
)
add_classes(
    "class_sizes",
    lambda h: h.groupBy("structure_hash").agg(F.count("*").alias("n_traces")),
    _HASH_SQL + "SELECT structure_hash, count(*) AS n_traces FROM th GROUP BY 1",
)


def class_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = chain_spans(spark, sf_dir)
    hashes = scratch.materialise(structure.structure_hashes(spans, 8), "classes")
    return structure.traces_by_class(spans, hashes, CHAIN)


QUERIES["class_expand"] = class_expand
ORACLES["class_expand"] = CHAIN_SQL + traces_sql(CHAIN)


def class_search(spark: SparkSession, sf_dir: str, p: TracePattern, where: str = "true") -> DataFrame:
    """Search by classes, part by part: each part matches its shapes once, on exemplars of its own."""
    found = []
    for k in range(PARTS):
        spans = order_spans(spark, sf_dir, k, PARTS).where(where)
        hashes = structure.class_table([spans], 4)
        with dropping_shuffles(spark):
            found.append(scratch.materialise(search(spans, p, hashes=hashes), "found"))
    return reduce(DataFrame.unionByName, found)


QUERIES["class_pattern"] = lambda spark, sf_dir: class_search(spark, sf_dir, ONE_CALL)
ORACLES["class_pattern"] = SPANS_SQL + traces_sql(ONE_CALL)

# Without the roots of finished orders, their lines are orphans; all of these are in the class.
CALL_OF_PART = TracePattern({0: "line.AF", 1: "part.PROMO"}, [(0, 1)])
QUERIES["class_orphans"] = lambda spark, sf_dir: class_search(spark, sf_dir, CALL_OF_PART, "service <> 'order.F'")
ORACLES["class_orphans"] = SPANS_SQL + traces_sql(CALL_OF_PART)

# Inverted index
add("inverted_build", lambda s: inverted.build(s), "SELECT DISTINCT attr_key, attr_value, batch, trace_id FROM spans")


def written(spans: DataFrame, rows: DataFrame, writer: Callable, label: str) -> str:
    path = scratch.new_path(spans.sparkSession, label)
    writer(rows, path)
    return path


def inverted_probe(spans: DataFrame) -> DataFrame:
    path = written(spans, inverted.build(spans, ["priority", "brand"]), inverted.write, "inverted")
    return inverted.probe(spans.sparkSession.read.parquet(path), "priority", "1-URGENT", YEAR)


add("inverted_probe", inverted_probe, f"SELECT DISTINCT batch, trace_id FROM spans WHERE attr_key = 'priority' AND attr_value = '1-URGENT' AND {_WIN}")
add("inverted_freshness", lambda s: inverted.build(s, ["nation"], after=YEAR.end_s), f"SELECT DISTINCT attr_key, attr_value, batch, trace_id FROM spans WHERE attr_key = 'nation' AND b_end > {YEAR.end_s}")
add(
    "inverted_big_values",
    lambda s: inverted.large_values(inverted.build(s, ["brand"]), "brand", 20_000),
    "SELECT attr_value, count(*) * 32 AS n_bytes, min(b_start) AS start_s, max(b_end) AS end_s FROM (SELECT DISTINCT attr_value, batch, trace_id, b_start, b_end FROM spans WHERE attr_key = 'brand') GROUP BY 1 HAVING count(*) * 32 >= 20000",
)
add(
    "inverted_sizes",
    lambda s: inverted.build(s).groupBy("attr_key", "attr_value").agg(F.count("*").alias("n_ids")),
    "SELECT attr_key, attr_value, count(*) AS n_ids FROM (SELECT DISTINCT attr_key, attr_value, batch, trace_id FROM spans) GROUP BY 1, 2",
)

# Range index
add(
    "range_nodes",
    lambda s: ranges.build(s, "latency").select("node_start", "value_str", "batch", "trace_id"),
    "SELECT start_ns // 1000000000 - (start_ns // 1000000000) % 100 AS node_start, CAST(end_ns - start_ns AS VARCHAR) AS value_str, batch, trace_id FROM spans",
)
add(
    "range_summary",
    lambda s: ranges.summaries(ranges.build(s, "latency")),
    """SELECT n - n % 500 AS summary_start, n AS node_start, CAST(min(v) AS DOUBLE) AS min_value, CAST(max(v) AS DOUBLE) AS max_value, count(*) AS n_rows
    FROM (SELECT start_ns // 1000000000 - (start_ns // 1000000000) % 100 AS n, end_ns - start_ns AS v FROM spans) GROUP BY 1, 2""",
)


def range_probe(spans: DataFrame, lexical: bool = False) -> DataFrame:
    path = written(spans, ranges.build(spans, "latency"), ranges.write, "range")
    return ranges.probe(spans.sparkSession.read.parquet(path), "latency", Compare.GT, "30000000000", YEAR, lexical=lexical)


_SPAN_IN = f"start_ns // 1000000000 BETWEEN {YEAR.start_s} AND {YEAR.end_s}"
add("range_probe", range_probe, f"SELECT DISTINCT batch, trace_id FROM spans WHERE {_SPAN_IN} AND end_ns - start_ns > 30000000000")
add("range_probe_lexical", lambda s: range_probe(s, True), f"SELECT DISTINCT batch, trace_id FROM spans WHERE {_SPAN_IN} AND CAST(end_ns - start_ns AS VARCHAR) > '30000000000'")
add(
    "range_split",
    lambda s: ranges.build(s, "latency").groupBy("node_start").agg(F.ceil(F.sum(F.length("value_str") + F.length("batch") + F.length("trace_id")) / 4096).alias("n_nodes")),
    "SELECT start_ns // 1000000000 - (start_ns // 1000000000) % 100 AS node_start, CAST(ceil(sum(length(CAST(end_ns - start_ns AS VARCHAR)) + length(batch) + length(trace_id)) / 4096) AS BIGINT) AS n_nodes FROM spans GROUP BY 1",
)

# Bloom index
LEAF_S, FAN, LEVELS = 8_640_000, 4, 3
LOOKUP = "00000000000000000000000000000007"
add(
    "bloom_leaf_split",
    lambda s: bloom.leaf_split(s, LEAF_S),
    f"""SELECT leaf_start, batch, CASE WHEN b_start >= leaf_start AND b_end < leaf_start + {LEAF_S} THEN 'inclusive' WHEN b_start < leaf_start THEN 'early' ELSE 'late' END AS kind
    FROM (SELECT *, unnest(generate_series(b_start - b_start % {LEAF_S}, b_end - b_end % {LEAF_S}, {LEAF_S})) AS leaf_start FROM (SELECT DISTINCT batch, b_start, b_end FROM spans))""",
)
add(
    "bloom_parents",
    lambda s: bloom.leaf_split(s, LEAF_S).select((F.col("leaf_start") - F.col("leaf_start") % (LEAF_S * FAN)).alias("parent_start"), "leaf_start").distinct(),
    f"""SELECT DISTINCT leaf_start - leaf_start % {LEAF_S * FAN} AS parent_start, leaf_start FROM (
    SELECT unnest(generate_series(b_start - b_start % {LEAF_S}, b_end - b_end % {LEAF_S}, {LEAF_S})) AS leaf_start FROM (SELECT DISTINCT b_start, b_end FROM spans))""",
)


def bloom_nodes(spans: DataFrame) -> DataFrame:
    return scratch.materialise(bloom.build(spans, "trace_id", LEAF_S, FAN, LEVELS, 2_000, 1e-3), "bloom")


def bloom_candidates(spans: DataFrame) -> DataFrame:
    return bloom.probe(bloom_nodes(spans), LOOKUP, LEVELS, n=2_000, fpp=1e-3)




def bloom_hits(spans: DataFrame) -> DataFrame:
    """Candidate batches of several ids that do hold them; none may be missing."""
    nodes, ids = bloom_nodes(spans), [LOOKUP, *THREE[:2]]
    there = spans.where(F.col("trace_id").isin(ids)).select("trace_id", "batch").distinct()
    found = reduce(DataFrame.unionByName, [bloom.probe(nodes, x, LEVELS, n=2_000, fpp=1e-3).select(F.lit(x).alias("trace_id"), "batch") for x in dict.fromkeys(ids)])
    return there.join(found, ["trace_id", "batch"], "left_semi")


add("bloom_candidates", bloom_hits, f"SELECT DISTINCT trace_id, batch FROM spans WHERE trace_id IN ({', '.join(map(repr, [LOOKUP, *THREE[:2]]))})")
add("bloom_probe_verified", lambda s: bloom.verify(s, bloom_candidates(s), "trace_id", LOOKUP), f"SELECT DISTINCT batch, trace_id FROM spans WHERE trace_id = '{LOOKUP}'")
add(
    "bloom_root",
    lambda s: bloom.widest(bloom.build(s, "trace_id", LEAF_S, FAN, LEVELS, 2_000, 1e-3)),
    f"SELECT min(x - x % {LEAF_S * FAN**2}) AS start_s, min(x - x % {LEAF_S * FAN**2}) + {LEAF_S * FAN**2} AS end_s FROM (SELECT start_ns // 1000000000 AS x FROM spans)",
)


def bitmap_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that have orders and those that have none, by bitmaps of their numbers."""
    of = lambda name, c: table(spark, sf_dir, name).groupBy(F.bitmap_bucket_number(c).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(c)).alias("bits"))
    ordered, known = of("orders", "o_custkey"), of("customer", "c_custkey")
    parts = [bloom.combine(ordered, known, how, ["bucket"]).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("bigint").alias("n")).select(F.lit(how).alias("how"), "n") for how in ("and", "or", "xor")]
    return reduce(DataFrame.unionByName, parts)


QUERIES["bitmap_sets"] = bitmap_sets
ORACLES["bitmap_sets"] = """
WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT DISTINCT c_custkey AS k FROM customer),
b AS (SELECT o.k AS a, c.k AS b FROM o FULL JOIN c ON o.k = c.k)
SELECT 'and' AS how, count(*) AS n FROM b WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT 'or', count(*) FROM b
UNION ALL SELECT 'xor', count(*) FROM b WHERE a IS NULL OR b IS NULL"""
add("trace_lookup", lambda s: bloom.lookup(s, "trace_id", LOOKUP), f"SELECT min(batch) AS batch FROM spans WHERE trace_id = '{LOOKUP}'")
add("span_lookup", lambda s: bloom.lookup(s, "span_id", "00000000000003e8"), "SELECT min(batch) AS batch FROM spans WHERE span_id = '00000000000003e8'")

# Planner
ATTR = Condition(0, "attr:priority", Compare.EQ, "1-URGENT")
SLOW_LINE = Condition(1, "latency", Compare.GT, 5_000_000_000)


def indexed(spans: DataFrame, until: list[int], *indexes: tuple[str, IndexKind]) -> Catalog:
    """A catalog of indexes that were updated up to each of these seconds."""
    catalog = Catalog(spans.sparkSession)
    for prop, kind in indexes:
        for second in until:
            upkeep.update(spans, catalog, prop, kind, second, **({"granularity": LEAF_S, "fan": FAN, "levels": LEVELS} if kind is IndexKind.BLOOM else {}))
    return catalog


def indexed_search(spans: DataFrame, *until: int) -> DataFrame:
    return search(spans, ONE_CALL, conditions=[ATTR, SLOW_LINE], catalog=indexed(spans, list(until), (ATTR.prop, IndexKind.INVERTED), ("latency", IndexKind.RANGE)))


_INDEXED = traces_sql(ONE_CALL, "AND n0.attr_key = 'priority' AND n0.attr_value = '1-URGENT' AND n1.end_ns - n1.start_ns > 5000000000")
add("index_search", lambda s: indexed_search(s, 4_000_000_000), _INDEXED)
add("index_freshness", lambda s: indexed_search(s, YEAR.start_s), _INDEXED)
add("index_incremental", lambda s: indexed_search(s, YEAR.start_s, YEAR.end_s, 4_000_000_000), _INDEXED)
add("index_in_window", lambda s: search(s, ONE_CALL, YEAR, [ATTR, SLOW_LINE], catalog=indexed(s, [4_000_000_000], (ATTR.prop, IndexKind.INVERTED), ("latency", IndexKind.RANGE))), f"{_INDEXED} AND {_IN}")
_BY_ATTR = traces_sql(ONE_CALL, "AND n0.attr_key = 'priority' AND n0.attr_value = '1-URGENT'")
add("index_bloom_search", lambda s: search(s, ONE_CALL, conditions=[ATTR], catalog=indexed(s, [4_000_000_000], (ATTR.prop, IndexKind.BLOOM))), _BY_ATTR)
add("bloom_incremental", lambda s: search(s, ONE_CALL, conditions=[ATTR], catalog=indexed(s, [YEAR.start_s, 4_000_000_000], (ATTR.prop, IndexKind.BLOOM))), _BY_ATTR)
EXACT = Condition(1, "start_ns", Compare.GT, 852_076_800_001_000_000)
add("index_range_time", lambda s: search(s, ONE_CALL, conditions=[EXACT], catalog=indexed(s, [4_000_000_000], ("start_ns", IndexKind.RANGE))), traces_sql(ONE_CALL, f"AND n1.start_ns > {EXACT.value}"))
LABEL = Condition(1, "name", Compare.GT, "lind")
add("index_range_text", lambda s: search(s, ONE_CALL, conditions=[LABEL], catalog=indexed(s, [YEAR.end_s], ("name", IndexKind.RANGE))), traces_sql(ONE_CALL))
add(
    "index_intersection",
    lambda s: intersect([inverted.probe(inverted.build(s), "priority", "1-URGENT"), inverted.probe(inverted.build(s), "brand", "Brand#12"), search(s, ONE_CALL)]),
    "SELECT batch, trace_id FROM spans WHERE attr_key = 'priority' AND attr_value = '1-URGENT' INTERSECT SELECT batch, trace_id FROM spans WHERE attr_key = 'brand' AND attr_value = 'Brand#12' INTERSECT " + traces_sql(ONE_CALL),
)
add(
    "union_batches",
    lambda s: search(s, ONE_CALL).unionByName(search(s, CANONICAL)),
    f"{traces_sql(ONE_CALL)} UNION ALL {traces_sql(CANONICAL)}",
)
add(
    "union_distinct",
    lambda s: search(s, HEIGHT).unionByName(search(s, CANONICAL)).distinct(),
    f"{traces_sql(HEIGHT)} UNION {traces_sql(CANONICAL)}",
)
add("count_traces_spans", lambda s: counts.traces_and_spans(s), "SELECT count(DISTINCT trace_id) AS n_traces, count(DISTINCT span_id) AS n_spans FROM spans")
QUERIES["object_sizes"] = lambda spark, sf_dir: counts.object_sizes(spark, sf_dir)
add(
    "median_latency",
    lambda s: counts.median(s.select((F.col("end_ns") - F.col("start_ns")).alias("v")), "v"),
    "SELECT median(end_ns - start_ns) AS median FROM spans",
)


def streaming_attr_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive as files; the index of (type, day, user) is kept up by micro-batches."""
    schema = table(spark, sf_dir, "events").schema
    base = scratch.new_path(spark, "stream")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    rows = lambda d: d.select(F.lit("event_type").alias("attr_key"), F.col("event_type").alias("attr_value"), F.date_format("ts", "yyyy-MM-dd").alias("batch"), F.col("user_id").cast("string").alias("trace_id"))
    maintain(stream, rows, f"{base}/index", f"{base}/checkpoint")
    return read_index(spark, f"{base}/index")


QUERIES["streaming_attr_index"] = streaming_attr_index
ORACLES["streaming_attr_index"] = "SELECT DISTINCT 'event_type' AS attr_key, event_type AS attr_value, strftime(ts, '%Y-%m-%d') AS batch, CAST(user_id AS VARCHAR) AS trace_id FROM events"
