"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarflow.session import materialise, scratch_path

__all__ = ["crc32_of_id", "materialise", "numbered", "own_columns", "scratch_path", "table", "words_of"]

#: The characters that separate words: space, and tab to carriage return.
BLANK = "[\\x20\\x09-\\x0D]+"
#: Up to about this many files a table is bucketed without a shuffle before.
FILES = 4000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def own_columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    """The columns that an operator passes through: not those that it adds, nor those that begin with an underscore, which
    are its working columns."""
    return [c for c in df.columns if c not in but and not c.startswith("_")]


def numbered(docs: DataFrame, number: str) -> DataFrame:
    """Writes the rows once, with a number of their own, in buckets of that number, and reads them back.

    The numbers stay what they are, and joins on them send only the other side to the buckets: no text is shuffled.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(*[F.col(f"`{c}`") for c in own_columns(docs)], F.monotonically_increasing_id().alias(number))
    if len(docs.inputFiles()) * n > FILES:
        rows = rows.repartition(n, number)
    name = f"bazaarflow_{uuid.uuid4().hex}"
    rows.write.bucketBy(n, number).option("compression", "zstd").option("path", scratch_path(spark, "numbered")).saveAsTable(name)
    return spark.table(name)


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def crc32_of_id(doc_id: Column) -> Column:
    """Unsigned CRC-32 of the id written as text; of "" for a null id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
