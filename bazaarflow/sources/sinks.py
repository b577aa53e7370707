"""Writers, and the projections exported to other systems."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarflow import vocab
from bazaarflow.functions.rules import lit_map
from bazaarflow.functions.text import cut, drop_tags
from bazaarflow.operators.upsert import upsert


def write_table(df: DataFrame, path: str, *, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def rebuild_or_merge(current: DataFrame | None, fresh: DataFrame, key: Sequence[str], *, rebuild: bool) -> DataFrame:
    """The table after a run: only the fresh rows on a rebuild, else the upsert of both."""
    return fresh if rebuild or current is None else upsert(current, fresh, key)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV of the listed columns that exist."""
    df.select(*[c for c in columns if c in df.columns]).write.mode("overwrite").option("header", True).option(
        "escape", '"').csv(path)


def product_export(df: DataFrame, *, methods=vocab.SOURCE_METHODS, name_cap: int | None = None, text_cap: int | None = None,
                   names: Mapping[str, str] | None = None) -> DataFrame:
    """Products in the shop's fields, with defaults; ``names`` renames fields to those of the target system."""
    activity = F.when(F.col("activity").isin("EXCURSION", "TICKET", "TRANSFER"), F.col("activity")).otherwise(F.lit("EXCURSION"))
    price = F.coalesce(F.col("price").cast("double"), F.lit(0.0))
    out = df.select(
        "product_id", cut(F.col("title"), name_cap).alias("name"), F.lit("service").alias("type"), price.alias("list_price"),
        F.nullif(cut(drop_tags(F.col("description")), text_cap), F.lit("")).alias("description"),
        F.nullif("city", F.lit("")).alias("city"), F.nullif("country", F.lit("")).alias("country"), activity.alias("activity"),
        F.nullif("category", F.lit("")).alias("category"), F.coalesce("duration_minutes", F.lit(0)).alias("duration_minutes"),
        F.coalesce("price_is_estimated", F.lit(False)).alias("price_estimated"), price.alias("original_price"),
        F.lit("EUR").alias("original_currency"), F.lit(True).alias("automatic"), F.col("url").alias("source_url"),
        F.col("url").alias("booking_url"),
        F.coalesce(F.try_element_at(lit_map(methods), F.col("source")), F.lit("playwright")).alias("method"),
        "run_id", F.coalesce(F.col("similarity").cast("double"), F.lit(0.0)).alias("similarity"), "supplier_name",
        "supplier_domain", F.lit(True).alias("sale_ok"), F.lit(True).alias("purchase_ok"))
    for old, new in (names or {}).items():
        out = out.withColumnRenamed(old, new)
    return out


def supplier_export(df: DataFrame, *, zones=vocab.EXPORT_ZONES, default_zone: str = "2", connections=vocab.CONNECTION_CODES,
                    names: Mapping[str, str] | None = None) -> DataFrame:
    """Suppliers in the shop's fields: zone by country, connection code, counts."""
    code = F.upper(F.trim(F.coalesce("connection", F.lit("NONE"))))
    out = df.select(
        "supplier_id", F.coalesce("name", F.lit("Unknown Supplier")).alias("name"),
        F.when(F.coalesce("domain", F.lit("")) != "", F.concat(F.lit("https://"), F.col("domain"))).alias("website"),
        F.lit(True).alias("is_company"), F.coalesce("score", F.lit(0)).alias("score"), F.lit("scraped").alias("status"),
        F.coalesce("has_api", F.lit(False)).alias("has_api"), F.coalesce("has_channel", F.lit(False)).alias("has_channel"),
        "channel_name", F.coalesce(F.try_element_at(lit_map(connections), code), F.lit("NONE")).alias("connection"),
        F.coalesce(F.try_element_at(lit_map(zones), F.col("country")), F.lit(default_zone)).alias("zone"), "run_id",
        F.coalesce("scraped", F.lit(0)).alias("products_scraped"), F.coalesce("accepted", F.lit(0)).alias("products_accepted"))
    for old, new in (names or {}).items():
        out = out.withColumnRenamed(old, new)
    return out
