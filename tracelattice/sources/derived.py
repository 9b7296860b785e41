"""Spans derived from the order tables, and how spans are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH_S = 2_592_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_spans(spark: SparkSession, sf_dir: str, part: int = 0, parts: int = 1) -> DataFrame:
    """One trace per order: order, its lines, each line's part, each part's supplier.

    ``part`` of ``parts``: whole traces by a hash of the order, taken before anything is shuffled; every trace
    is in one part."""
    keys = {"orders": "o_orderkey", "lineitem": "l_orderkey"} if parts > 1 else {}
    taken = lambda key: F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(parts)) == part
    t = lambda name: table(spark, sf_dir, name).where(taken(keys[name])) if name in keys else table(spark, sf_dir, name)
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    lines = t("lineitem").withColumn("seq", F.row_number().over(order)).alias("l")
    region = t("region").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    supplier = t("supplier").join(region, F.col("s_nationkey") == F.col("n_nationkey"))
    orders = t("orders")
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    bucket = F.call_function("div", us, F.lit(1_000_000 * BATCH_S))
    orders = orders.withColumns({
        "us": us,
        "batch": F.concat(F.lpad((bucket % 100).cast("string"), 2, "0"), F.lit("-"), bucket * BATCH_S, F.lit("-"), bucket * BATCH_S + (BATCH_S - 1)),
    })

    def level(rows: DataFrame, k: int, seq: Column, service: Column, amount: Column, key: str, kind: str, value: Column) -> DataFrame:
        base = F.col("o_orderkey") * 1000
        parent = F.lit(None).cast("string") if k == 0 else F.format_string("%016x", base if k == 1 else base + seq * 10 + (k - 1))
        start = F.col("us") * 1000 + k * 1_000_000
        cents = F.floor(amount * 100 + 0.5).cast("bigint")
        return rows.select(
            "batch", F.format_string("%032x", "o_orderkey").alias("trace_id"),
            F.format_string("%016x", base + seq * 10 + k).alias("span_id"), parent.alias("parent_span_id"),
            service.alias("service"), F.lit(("order", "line", "part", "supplier")[k]).alias("name"),
            start.alias("start_ns"), (start + cents * 1000).alias("end_ns"),
            F.array(F.struct(F.lit(key).alias("key"), F.lit(kind).alias("type"), value.cast("string").alias("value"))).alias("attributes"),
        )

    seq = F.col("seq").cast("bigint")
    of_order = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    of_part = of_order.join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    of_supplier = of_order.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return (
        level(orders, 0, F.lit(0), F.concat(F.lit("order."), "o_orderstatus"), F.col("o_totalprice"), "priority", "string", F.col("o_orderpriority"))
        .unionByName(level(of_order, 1, seq, F.concat(F.lit("line."), "l_returnflag", "l_linestatus"), F.col("l_extendedprice"), "http.status_code", "int", 200 + (F.col("l_quantity").cast("bigint") % 4) * 100))
        .unionByName(level(of_part, 2, seq, F.concat(F.lit("part."), "p_type"), F.col("p_retailprice"), "brand", "string", F.col("p_brand")))
        .unionByName(level(of_supplier, 3, seq, F.concat(F.lit("supp."), "r_name"), F.abs("s_acctbal"), "nation", "string", F.col("n_name")))
    )


def chain_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace per conversation: each turn calls the next."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    first = F.min("turn").over(Window.partitionBy("conv_id"))
    span = lambda turn: F.format_string("%016x", F.col("conv_id") * 1000 + turn)
    return c.select(
        F.lit("00-0-99999").alias("batch"), F.format_string("%032x", "conv_id").alias("trace_id"), span(F.col("turn")).alias("span_id"),
        F.when(F.col("turn") > first, span(F.col("turn") - 1)).alias("parent_span_id"), F.col("role").alias("service"), F.lit("turn").alias("name"),
        (F.col("turn") * 1_000_000_000).alias("start_ns"), ((F.col("turn") + 1) * 1_000_000_000).alias("end_ns"),
        F.array(F.struct(F.lit("role").alias("key"), F.lit("string").alias("type"), F.col("role").alias("value"))).alias("attributes"),
    )


def write_spans(spans: DataFrame, path: str) -> None:
    """Folders by batch (time pruning), rows sorted by service (label pruning by row-group statistics).

    Rows are dealt by trace within a batch, so a large batch has many files."""
    spans.repartition("batch", F.pmod(F.xxhash64("trace_id"), F.lit(8))).sortWithinPartitions("batch", "service", "trace_id").write.partitionBy("batch").parquet(path)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_spans(spans: DataFrame, table: str, buckets: int) -> DataFrame:
    """A table bucketed and sorted by (batch, trace_id): pattern joins, class hashing and per-trace
    aggregations read it without a shuffle.  Batches are skipped by row-group statistics."""
    spans.repartition(buckets, "batch", "trace_id").write.mode("overwrite").bucketBy(buckets, "batch", "trace_id").sortBy("batch", "trace_id").saveAsTable(table)
    return spans.sparkSession.table(table)
