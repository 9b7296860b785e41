"""Cross-document line frequency (native): hash normalised lines, count distinct documents per host,
remove lines above the limit, reject documents that lose most of their words.  Documents of a host are told
apart by their whole texts, so equal copies count once for a line and near copies each.

Plan: one pass over the texts writes a narrow table (a row identity, counts, line hashes); everything
that moves between machines is hashes.  A line's frequency is a partial aggregation; the frequent
lines are written before they join the lines again, so a line of a third of all rows is a skewed
join that Spark splits.

Defined cases: a null text is empty; a null host is the host ''; null or repeated doc_ids play no part, and
every row gets a verdict; a very long text is one row of its task, of which only hashes move; a line in just
``MAX_DOCS`` documents stays, and a document that loses just half of its words is kept; an empty table gives
an empty result; input columns named like an output give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelattice import scratch
from tracelattice.llm.common import RID, ROW, pack, unpack, whole

SYMBOLS = "#*$%&|<>"  # fixed value
MIN_WORDS = 50
MAX_DOCS = 10  # a line of more documents of one host is boilerplate
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


RUN = "[\\x09\\x0B-\\x0D][\\x20\\x09\\x0B-\\x0D]*|\\x20[\\x20\\x09\\x0B-\\x0D]+"  # white space within a line that is not one space


def normal_lines(text: Column) -> Column:
    """Lines in order, in lower case, their words apart by one space; a line without a word is empty."""
    return F.transform(F.split(F.lower(F.regexp_replace(text, RUN, " ")), "\n"), lambda x: F.btrim(x, F.lit(" ")))


def count_words(line: Column) -> Column:
    """Words of a normal line that has one."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def measure(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """Adds the base counts, ``lines``: (hash, n_words) of each line with a word, in order, and
    ``identity``, the hash of the whole text.

    Windows are compared by 64-bit hashes within one text.
    """
    df = docs.select(pack(docs), whole(F.col(f"`{text}`")).alias("t"), whole(F.col(f"`{host}`")).alias("host"))
    bare = F.transform(F.split(F.regexp_replace("t", RUN, " "), "\n"), lambda x: F.btrim(x, F.lit(" ")))
    df = df.select(
        ROW, "host", F.xxhash64("t").alias("identity"),
        (F.length("t") - F.length(F.regexp_replace("t", f"[{SYMBOLS}]+", ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]"))).alias("l"),
        F.array_remove(bare, "").alias("b"),
    )
    df = df.withColumn("joined", F.array_join("b", " ")).withColumn("w", F.when(F.size("b") == 0, F.array().cast("array<string>")).otherwise(F.split("joined", " ")))
    window = lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))
    df = df.select(
        ROW, "host", "identity", "n_symbols", F.size("w").cast("bigint").alias("n_words"),
        F.length(F.replace("joined", F.lit(" "), F.lit(""))).cast("bigint").alias("word_chars"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        F.transform("b", lambda x: F.struct(F.xxhash64(F.lower(x)).alias("h"), count_words(x).cast("bigint").alias("n"))).alias("lines"),
        F.slice(F.transform("w", window), F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))).alias("h"),
    )
    # Only texts with a repeated window are sorted.
    ordered = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), ordered)).drop("h")
    twice = lambda x, j: F.coalesce(F.get("s", j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", j + 1)["h"] == x["h"], F.lit(False))
    df = df.withColumn("p", F.sort_array(F.transform(F.filter("s", twice), lambda x: x["i"]))).drop("s")
    # A repeated window covers its 3 words, less what the next one covers.
    covered = F.aggregate(F.transform("p", lambda x, k: F.coalesce(F.least(F.lit(3), F.get("p", k + 1) - x), F.lit(3))), F.lit(0), lambda a, b: a + b)
    return df.select(ROW, "host", *METRICS[:4], F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"), "lines", "identity")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def frequent_lines(measured: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, h) of lines in more than ``max_docs`` distinct documents of a host; equal texts are one document."""
    once = measured.select("host", "identity", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).distinct()
    return once.groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs).select("host", "h")


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_docs: int = MAX_DOCS, clean: bool = False) -> DataFrame:
    """The rows of ``docs`` with the base counts, ``base_failed``, ``removed_words`` and ``kept``.

    A document is rejected if a base rule fails or if frequent lines hold more than half of its words.
    ``clean``: its text comes without the frequent lines (else the text is left out).
    """
    names = [c for c in docs.columns if clean or c != text]
    measured = measure(docs, text, host).withColumn(RID, F.monotonically_increasing_id())
    if not clean:
        measured = measured.withColumn(ROW, F.struct(F.lit(0).alias("__none"), *[F.col(f"{ROW}.`{c}`").alias(c) for c in names]))
    kept_rows = scratch.materialise(measured, "quality")
    frequent = scratch.materialise(frequent_lines(kept_rows, max_docs), "lines")
    lines = kept_rows.select(RID, "host", F.explode("lines").alias("x")).select(RID, "host", "x.h", "x.n")
    gone = (
        lines.join(frequent, ["host", "h"], "inner")
        .groupBy(RID).agg(F.sum("n").alias("removed_words"), *([F.collect_set("h").alias("gone")] if clean else []))
    )
    out = kept_rows.drop("lines", "host").join(gone, RID, "left")
    removed = F.coalesce("removed_words", F.lit(0)).cast("bigint")
    added = {m: F.col(m) for m in METRICS} | {
        "base_failed": base_failed(), "removed_words": removed, "kept": ~base_failed() & (2 * removed <= F.col("n_words")),
    }
    if clean:
        t = whole(F.col(f"{ROW}.`{text}`"))
        stay = F.filter(F.arrays_zip(F.split(t, "\n").alias("raw"), normal_lines(t).alias("line")), lambda x: ~F.array_contains("gone", F.xxhash64(x["line"])))
        added[text] = F.when(F.col("gone").isNull(), F.col(f"{ROW}.`{text}`")).otherwise(F.array_join(F.transform(stay, lambda x: x["raw"]), "\n"))
    return unpack(out, names, added)
