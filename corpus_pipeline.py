"""Documents to training tokens in five stages; each works on all that the one before it kept.

Defined cases, for every stage: null or repeated doc_ids are rows of their own, and null texts are empty (they
fail the quality rules); null ``lang``, ``source`` and ``n_chars`` are carried (a null source is the host '');
very long texts are worked on whole; ties of a near-duplicate group go to the smallest doc_id, nulls last, then
the row read first; columns beyond those of documents are left out, whatever their names; empty tables give no
rows.  ``n_chars`` is the length of the text as it is after the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelattice import scratch
from tracelattice.llm import bpe, decontaminate, quality, secrets, simhash
from tracelattice.llm.common import RID, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with a row identity that stays the same in every later job."""
    return scratch.materialise(docs.withColumn(RID, F.monotonically_increasing_id()), "stage")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; so do documents that fail the rules or are depleted."""
    return documents(quality.judge(docs, clean=True).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies (0.8 of their five-word shingles) stays."""
    rows = identified(docs)
    first = simhash.similar(rows).where(F.col(RID) == F.col("first_rid")).select(RID)
    return rows.join(first, RID, "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    rows = identified(docs)
    held = decontaminate.find(rows, table(spark, sf_dir, "benchmark")).select(F.col("row").alias(RID))
    return rows.join(held, RID, "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return documents(secrets.redact(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids)."""
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), RANKS, public_tokenizers.PATTERN)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("encoding", encoding),
]

ORACLE_SQL = None  # fingerprints, alignments and merges have no SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = scratch.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
