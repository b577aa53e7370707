"""A keyed table in hash partitions, of which an upsert rewrites only those it touches.

A row lies in the folder ``part=<hash of the key modulo n>``. An upsert takes the delta to its partitions, reads only the folders
it needs, merges, and replaces exactly these by a dynamic partition overwrite. All other files stay as they are.
The number of partitions and the columns belong to the table: they are kept in ``_layout`` beside the data.

An upsert reads what it overwrites, so the merged rows are first written to a staging folder. A run that ends before the last
step leaves the table as it was, or some partitions already merged; running the same delta again gives the wanted table in both cases.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarflow.operators.upsert import upsert
from bazaarflow.session import materialise

PART = "part"


def part_of(key: Sequence[str], n: Column | int) -> Column:
    return F.pmod(F.xxhash64(*key), n if isinstance(n, Column) else F.lit(n)).cast("int")


def _write(df: DataFrame, path: str) -> None:
    # one file a partition; without it every task would leave a file in every folder
    df.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def layout(spark: SparkSession, path: str) -> tuple[int, T.StructType]:
    """The number of partitions and the columns of the files."""
    row = spark.read.schema("parts int, columns string").json(f"{path}/_layout").first()
    return row["parts"], T.StructType.fromJson(json.loads(row["columns"]))


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(layout(spark, path)[1]).parquet(f"{path}/rows")


def read_table(spark: SparkSession, path: str, parts: Sequence[int] | None = None) -> DataFrame:
    """The table, or only some of its partitions."""
    df = _rows(spark, path)
    return (df if parts is None else df.where(F.col(PART).isin(*parts))).drop(PART)


def create_table(df: DataFrame, path: str, key: Sequence[str], *, parts: int = 64) -> None:
    """Writes a table of ``parts`` partitions; keys are taken to be unique."""
    placed = df.withColumn(PART, part_of(key, parts))
    spark = df.sparkSession
    spark.createDataFrame([(parts, placed.schema.json())], "parts int, columns string").coalesce(1).write.mode("overwrite").json(f"{path}/_layout")
    _write(placed, f"{path}/rows")


def upsert_table(path: str, delta: DataFrame, key: Sequence[str], *, stamp: str | None = None, order: str | None = None) -> list[int]:
    """Upserts ``delta`` as operators.upsert.upsert does, rewriting only the partitions in which it has rows; returns their numbers.

    Columns that the table lacks are left out; those that the delta lacks become null in the rows it replaces.
    """
    spark = delta.sparkSession
    n = layout(spark, path)[0]
    delta = materialise(delta.withColumn(PART, part_of(key, n)), "delta")
    touched = sorted(r[PART] for r in delta.select(PART).distinct().collect())  # at most n numbers
    if not touched:
        return []
    base = _rows(spark, path)
    columns = base.columns
    merged = upsert(base.where(F.col(PART).isin(*touched)), delta, [PART, *key], stamp=stamp, order=order)
    staged = materialise(merged.select(*columns), "merged")
    _write(staged, f"{path}/rows")
    return touched
