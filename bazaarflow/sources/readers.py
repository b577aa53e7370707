"""Table, dimension and file readers with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAD_SCHEMA = "company string, website string, snippet string, matched_keyword string, query string"
CITY_SCHEMA = ("id long, name string, country_id int, state_code string, latitude double, longitude double, "
               "timezone string")


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Parquet scan; filter and projection reach the files. Files with added columns are read together."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df if columns is None else df.select(*columns)


def read_evolving(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet written over time with columns added later; the missing ones are null."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def read_leads(spark: SparkSession, path: str) -> DataFrame:
    """Lead list CSV with quoted commas and line breaks."""
    return (spark.read.schema(LEAD_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
            .withColumn("query", F.trim("query")))


def read_cities(spark: SparkSession, path: str, countries: DataFrame, multi_line: bool = True) -> DataFrame:
    """City gazetteer JSON joined to its countries (country_id, country)."""
    cities = spark.read.schema(CITY_SCHEMA).option("multiLine", multi_line).json(path)
    return cities.join(countries, "country_id").select(
        F.col("id").alias("city_id"), "name", "country", F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))


def country_dimension(spark: SparkSession, rows: Sequence[tuple[str, int]]) -> DataFrame:
    """Country dimension (country_id, country, zone_id) from (name, zone) pairs given by the caller."""
    numbered = [(i, name, zone) for i, (name, zone) in enumerate(rows, 1)]
    return spark.createDataFrame(numbered, "country_id int, country string, zone_id int")


def supplier_rows(suppliers: DataFrame, *, run_id: str | None = None, country_ids: DataFrame | None = None,
                  connectable: bool = False) -> DataFrame:
    """Suppliers of a run, of countries, or with a connection."""
    if run_id is not None:
        suppliers = suppliers.where(F.col("run_id") == run_id)
    if connectable:
        suppliers = suppliers.where(F.col("has_api") | F.col("has_channel"))
    if country_ids is not None:
        suppliers = suppliers.join(country_ids.select("country_id"), "country_id", "left_semi")
    return suppliers


def suppliers_of_countries(suppliers: DataFrame, countries: DataFrame, pattern: str) -> DataFrame:
    """Suppliers in countries whose name contains the pattern, with the country name."""
    wanted = countries.where(F.contains(F.lower("country"), F.lit(pattern.lower())))
    return suppliers.join(wanted, "country_id")
