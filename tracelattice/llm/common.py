"""What several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelattice.session import dropping_shuffles  # noqa: F401

WS = " \t\n\x0b\x0c\r"  # fixed value: the characters between words
ROW, RID = "__row", "__rid"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str | Column) -> Column:
    """A text with null as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of other characters than ``WS``."""
    bare = F.btrim(text, F.lit(WS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def pack(df: DataFrame) -> Column:
    """The whole row as one struct, so that no column can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW)


def unpack(df: DataFrame, row_columns: list[str], added: dict[str, Column]) -> DataFrame:
    """The packed row's columns, then ``added``; an added column takes the place of one of its name."""
    kept = [F.col(f"{ROW}.`{c}`").alias(c) for c in row_columns if c not in added]
    return df.select(*kept, *[c.alias(n) for n, c in added.items()])


def without(df: DataFrame, names: list[str]) -> list[str]:
    return [c for c in df.columns if c not in names]
