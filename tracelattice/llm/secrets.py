"""Incremental blob ledger for secrets.

Each distinct text is a blob, named by the SHA-256 of its bytes.  The ledger holds what each rule version
found in each blob; only (blob, rule version) pairs that it lacks are scanned, and findings go back to all
rows of a blob.  What is new is found by names alone, before texts are joined to it.  Equal texts collapse
before the shuffle, so copies cost one row per task; the join back reads the written ledger, and a blob of a
third of all rows is a skewed join that Spark splits.  If few blobs are new Spark broadcasts their names and
only their texts move, else all distinct texts move once.

Each run writes its own folder of the ledger, so a run that fails leaves nothing behind; two runs that scan
the same blob at a time both write it, and readers take one.  The rule version is a digest of the rules.

Defined cases: a null text is the empty blob; a very long text is one row of its task; repeated rows each get
the blob's findings; null keys are carried; an empty table gives no rows; an input column named like an output
gives way to it.  A row whose blob the ledger lacks after the scan is an error.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelattice import scratch
from tracelattice.llm.common import dropping_shuffles, pack, unpack, whole

# Kind, words of which one must be in the lower-cased text, pattern, group that holds the
# secret, its least length.  Kinds that come first go first among spans of one start.
RULES = (
    ("assign", ("password", "passwd", "secret", "token", "api"), re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", (), re.compile(r"[0-9a-f]{32,}"), 0, 32),
    ("pem", ("private key",), re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), 0, 1),
    ("jwt", ("eyj",), re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"), 0, 1),
)
#: Another version as soon as a rule changes.
RULE_VERSION = hashlib.sha256(repr([(kind, hints, p.pattern, p.flags, group, least) for kind, hints, p, group, least in RULES]).encode()).hexdigest()[:16]
BASE_KINDS = ("assign", "access", "hex")
FINDING = "array<struct<start:long,rank:int,kind:string,stop:long>>"


def find(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank of the kind, kind, end) of every finding in a text, in code points, in order."""
    low = text.lower()
    out = []
    for rank, (kind, hints, pattern, group, least) in enumerate(RULES):
        if not hints or any(h in low for h in hints):
            out += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(out)


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """(blob, version, findings) of (blob, t)."""
    item = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("start", "rank", "kind", "stop"), x)) for x in find(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([RULE_VERSION] * b.num_rows, pa.string()), pa.array(found, pa.list_(item))], names=["blob", "version", "findings"])

    return blobs.select("blob", "t").mapInArrow(run, f"blob binary, version string, findings {FINDING}")


def ledger_rows(spark, ledger: str) -> DataFrame:
    """All runs of a ledger; no rows if it has none yet."""
    schema = f"blob binary, version string, findings {FINDING}"
    p = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(ledger)


def update_ledger(docs: DataFrame, ledger: str, text: str = "text") -> DataFrame:
    """Scan what the ledger lacks, append it, and return the blobs that were scanned."""
    spark = docs.sparkSession
    t = whole(F.col(f"`{text}`"))
    rows = docs.select(F.unhex(F.sha2(t, 256)).alias("blob"), t.alias("t"))
    seen = ledger_rows(spark, ledger).where(F.col("version") == RULE_VERSION).select("blob")
    blobs = rows.groupBy("blob").agg(F.first("t").alias("t"))
    with dropping_shuffles(spark):
        if not seen.isEmpty():  # names alone decide what is new
            new = scratch.materialise(rows.select("blob").distinct().join(seen, "blob", "left_anti"), "unseen")
            blobs = blobs.join(new, "blob", "left_semi")
        return scratch.materialise(scan_blobs(blobs), "scan", at=f"{ledger}/run={uuid.uuid4().hex}")


def scan(docs: DataFrame, text: str = "text", ledger: str | None = None) -> DataFrame:
    """The rows of ``docs`` with ``blob`` and ``findings``; ``ledger``: where earlier findings are kept."""
    spark = docs.sparkSession
    ledger = ledger or scratch.new_path(spark, "ledger")
    update_ledger(docs, ledger, text)
    return with_findings(docs, ledger, text)


def with_findings(docs: DataFrame, ledger: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with what the ledger has; a blob that it lacks is an error."""
    known = ledger_rows(docs.sparkSession, ledger).where(F.col("version") == RULE_VERSION).dropDuplicates(["blob", "version"]).select("blob", "findings")
    rows = docs.select(pack(docs), F.unhex(F.sha2(whole(F.col(f"`{text}`")), 256)).alias("blob"))
    lacking = F.raise_error(F.concat(F.lit("the ledger lacks blob "), F.lower(F.hex("blob"))))
    findings = F.when(F.col("findings").isNull(), lacking).otherwise(F.col("findings"))
    return unpack(rows.join(known, "blob", "left"), docs.columns, {"blob": F.col("blob"), "findings": findings})


def span_text(findings: Column) -> Column:
    """kind:start:end of each finding, joined by commas."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", ledger: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each maximal run of overlapping findings replaced by ``mark``."""
    found = scan(docs, text, ledger)
    start = F.transform("findings", lambda x: x["start"])
    reach = lambda x: F.array_max(F.transform(F.filter("findings", lambda y: y["start"] < x), lambda y: y["stop"]))
    begins = F.array_distinct(F.filter(start, lambda x: F.coalesce(reach(x) < x, F.lit(True))))
    after = lambda x: F.array_max(F.transform(F.filter("findings", lambda y: y["start"] < F.coalesce(x, F.lit(1 << 60))), lambda y: y["stop"]))
    t = F.col(f"`{text}`")
    cut = found.withColumn("__begins", begins)
    ends = F.transform("__begins", lambda _, i: after(F.get("__begins", i + 1)))
    cut = cut.withColumn("__ends", ends)
    kept = F.transform(
        F.sequence(F.lit(0), F.size("__begins")),
        lambda i: F.substring(t, (F.coalesce(F.get("__ends", i - 1), F.lit(0)) + 1).cast("int"), (F.coalesce(F.get("__begins", i), F.length(t).cast("long")) - F.coalesce(F.get("__ends", i - 1), F.lit(0))).cast("int")),
    )
    new = F.when(F.size("findings") == 0, t).otherwise(F.array_join(kept, mark))
    return cut.withColumn(text, new).select(*[F.col(f"`{c}`") for c in docs.columns])
