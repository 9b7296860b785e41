"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelattice import scratch
from tracelattice.llm import bpe, chunkdedup, decontaminate, licences, quality, secrets, sharding, simhash, training_order, warc
from tracelattice.llm.common import table
from tracelattice.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = scratch.new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), archive)
    return warc.captures(spark, archive)


def op2_chunk_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkdedup.repeats(table(spark, sf_dir, "documents"))


def op5_licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).select("doc_id", "paragraph", "family", "word")


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = scratch.new_path(spark, "shards")
    placed = training_order.materialise(table(spark, sf_dir, "documents"), shards, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    stored = training_order.read(spark, shards).select("slot", F.struct(F.size("tokens").cast("bigint").alias("n"), F.xxhash64("tokens").alias("hash")).alias("tokens"))
    return training_order.verified(placed, stored).select("doc_id", "seq", "n_tokens", "slot", "shard", "offset", F.col("tokens.n").alias("n_stored"), F.col("tokens.hash").alias("tokens_hash"))


def op4_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return out.select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_benchmark_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "score", "item_words", "end_word")


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments of one ledger: half of the blobs, by their digests, then all; the second scans what is left."""
    docs, ledger = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch.new_path(spark, "ledger")
    secrets.update_ledger(docs.where(F.sha2(F.coalesce("text", F.lit("")), 256) < "8"), ledger)
    out = secrets.scan(docs, ledger=ledger)
    n = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("findings", lambda x: x["kind"].isin(*secrets.BASE_KINDS))
    digest = F.sha2(secrets.span_text(base), 256).alias("base_sha256")
    return out.select("doc_id", *map(n, secrets.BASE_KINDS), digest, secrets.span_text(F.col("findings")).alias("spans"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    out = bpe.decode(ids, ranks, public_tokenizers.PATTERN)
    return out.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def op8_simhash_anchor_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_quality_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", *quality.METRICS, "base_failed", "kept")


def shipped(query: Query) -> Query:
    """The query, run where executors can import this package."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {f.__name__: shipped(f) for f in (op1_warc_transactions, op2_chunk_repeats, op3_training_order, op4_hypergeometric_sharding, op5_licence_paragraphs, op6_benchmark_alignment, op7_secret_ledger, op8_simhash_anchor_covering, op9_quality_line_frequency, op10_bpe_round_trip, pipeline)}


OP1_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, regexp_replace(coalesce(url, ''), '[\x00-\x20]+', '%20', 'g') AS u FROM pages),
d AS (SELECT *, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS best FROM p),
bits AS (SELECT *, list_aggregate(list_transform(range(0, 40), lambda i: lpad(bin(CAST('0x' || substr(x, CAST(i AS INTEGER) + 1, 1) AS INTEGER)), 4, '0')), 'string_agg', '') AS b,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type FROM d)
SELECT page_id, strlen(h) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_aggregate(list_transform(range(0, 5), lambda j: CAST(substr(b, CAST(5 * i + j + 1 AS INTEGER), 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER)), 'sum') + 1 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  record_type, CASE WHEN page_id <> best THEN best END AS refers_to,
  CAST(to_json(struct_pack(
    request := struct_pack(start_line := 'GET /' || regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/?([^#]*)', 1) || ' HTTP/1.1', host := regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)),
    response := struct_pack("type" := record_type, target_uri := u, media_type := 'text/html; charset=utf-8', payload_length := strlen(h)),
    metadata := struct_pack(page_id := CAST(page_id AS VARCHAR)))) AS VARCHAR) AS capture
FROM bits
"""

# Kind, pattern in the dialect of the SQL engine (letters in either case spelled out), group, least length.
OP7_KINDS = [
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
]


def op7_sql() -> str:
    """Matches and what lies between them tell the places."""
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(OP7_KINDS):
        re = pattern.replace("'", "''")
        parts.append(f"SELECT rid, {rank} AS rank, '{kind}' AS kind, unnest(range(1, len(ms) + 1)) AS i, ms, ps, '{re}' AS re, {group} AS g, {least} AS least FROM (SELECT rid, regexp_extract_all(t, '{re}') AS ms, string_split_regex(t, '{re}') AS ps FROM d)")
    length = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
e AS (SELECT rid, rank, kind, CAST({length.format("ps[1:i]")} + {length.format("ms[1:i - 1]")} AS BIGINT) AS a, length(ms[i]) AS n,
  CASE WHEN rank = 0 THEN length(regexp_extract(ms[i], '{OP7_KINDS[0][1].replace("'", "''")}', 2)) ELSE length(ms[i]) END AS secret, least FROM m),
f AS (SELECT *, kind || ':' || a || ':' || (a + n) AS span FROM e WHERE secret >= least)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY a, rank) FILTER (rank < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY a, rank), '') AS spans
FROM d LEFT JOIN f USING (rid) GROUP BY rid, doc_id
"""


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
pos AS (SELECT rid, generate_subscripts(ws, 1) AS i, unnest(ws) AS x FROM w),
tri AS (SELECT rid, i, x AS x1, lead(x, 1) OVER o AS x2, lead(x, 2) OVER o AS x3 FROM pos WINDOW o AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i FROM tri WHERE x3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, x1, x2, x3) > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) v(o) GROUP BY 1),
ln AS (SELECT rid, host, lower(array_to_string(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' ')) AS l,
       len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM (SELECT rid, host, unnest(ls) AS l FROM w)),
same AS (SELECT rid, min(rid) OVER (PARTITION BY t) AS document FROM d),
freq AS (SELECT host, l FROM ln JOIN same USING (rid) GROUP BY 1, 2 HAVING count(DISTINCT document) > 10),
gone AS (SELECT rid, sum(n) AS n FROM ln JOIN freq USING (host, l) GROUP BY 1),
m AS (SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines FROM w),
b AS (SELECT m.*, coalesce(cov.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS gone_words FROM m LEFT JOIN cov USING (rid) LEFT JOIN gone USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 2 * gone_words <= n_words AS kept FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_transactions": OP1_SQL, "op7_secret_ledger": op7_sql(), "op9_quality_line_frequency": OP9_SQL}
