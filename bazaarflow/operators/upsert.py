"""Keyed writes: upsert, insert-if-absent, updates, and the tables a new product turns into."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _one_per_key(delta: DataFrame, key: Sequence[str], order: str | None) -> DataFrame:
    """One row per key: the one with the highest ``order``; without an order, the greatest row."""
    return latest_per_key(delta, key, order or F.to_json(F.struct(*[F.col(c) for c in delta.columns])))


def upsert(base: DataFrame, delta: DataFrame, key: Sequence[str], *, stamp: str | None = None,
           order: str | None = None) -> DataFrame:
    """``base`` with the rows of ``delta`` replacing those of equal key and the rest appended.

    One shuffle on the key. Of several delta rows of one key the one with the highest ``order`` counts (without an order
    the greatest as JSON, so that the result is defined). Columns missing on one side become null. With ``stamp`` the
    replaced and added rows get the current time.
    """
    delta = _one_per_key(delta, key, order)
    if stamp:
        delta = delta.withColumn(stamp, F.current_timestamp())
    return base.join(delta.select(*key), list(key), "left_anti").unionByName(delta, allowMissingColumns=True)


def latest_per_key(df: DataFrame, key: Sequence[str], order) -> DataFrame:
    best = df.groupBy(*key).agg(F.max_by(F.struct(*[F.col(c).alias(c) for c in df.columns]), order).alias("_r"))
    return best.select("_r.*")


def insert_absent(base: DataFrame, new: DataFrame, key: Sequence[str], *, order: str | None = None) -> DataFrame:
    """``base`` with those rows of ``new`` whose key it lacks, one per key as in upsert()."""
    new = _one_per_key(new, key, order)
    return base.unionByName(new.join(base.select(*key), list(key), "left_anti"), allowMissingColumns=True)


def apply_updates(base: DataFrame, changes: DataFrame, key: Sequence[str], columns: Sequence[str], *,
                  overwrite_with_null: bool = False) -> DataFrame:
    """Sets ``columns`` of the rows of equal key; null changes leave the value unless told otherwise."""
    new = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = base.join(new, list(key), "left")
    for c in columns:
        value = F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) if overwrite_with_null \
            else F.coalesce(f"_new_{c}", c)
        out = out.withColumn(c, value)
    return out.select(*base.columns)


def append_log(batch: DataFrame, path: str, batch_id: int) -> None:
    """Writes one batch of an upsert log; writing the same batch again replaces it."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_log(spark, path: str, key: Sequence[str], order: str | None = None) -> DataFrame:
    """Current state of an upsert log: per key the row with the highest ``order``, of equal ones that of the newest batch;
    without an order the newest batch decides. A late, older row thus never replaces a newer one."""
    by = F.struct(order, "batch_id") if order else F.col("batch_id")
    return latest_per_key(spark.read.parquet(path), key, by).drop("batch_id")


def compact_log(spark, path: str, target: str, key: Sequence[str], order: str | None = None) -> None:
    """Writes the current state of a log as the first batch of a new one at ``target``."""
    append_log(read_log(spark, path, key, order), target, 0)


def catalogue_rows(new: DataFrame, service_type_ids: DataFrame | None = None, *, title_cap: int | None = None) -> dict[str, DataFrame]:
    """The product, detail and service rows of accepted new products, sharing one stable id.

    ``new``: product_key, title, description, type_label, type_code, category, locality_id, price, currency,
    operator, city, country. The id is hashed from product_key, so a repeated run gives the same rows.
    """
    from bazaarflow.functions.money import derived_prices
    from bazaarflow.functions.text import cut

    src = (new.withColumn("product_id", F.xxhash64("product_key")).withColumn("title", cut(F.col("title"), title_cap))
           .withColumn("text", F.coalesce(F.nullif("description", F.lit("")), "title"))
           .withColumn("place", F.concat_ws(", ", "city", "country")))
    price = derived_prices(F.col("price"))
    product = src.select(
        "product_id", F.col("title").alias("name"), F.col("text").alias("description"), "type_code",
        F.col("type_label").alias("product_type"), "category", "locality_id", "price",
        price["purchase"].alias("purchase_price"), price["minimum"].alias("min_price"), price["maximum"].alias("max_price"),
        F.coalesce("currency", F.lit("EUR")).alias("currency"), F.lit(0).alias("vat_rate"), F.lit(1).alias("active"),
        F.lit(1).alias("sellable"), F.coalesce("operator", F.lit("Scraped Supplier")).alias("operator"),
        F.col("place").alias("address"))
    languages = F.explode(F.array(F.lit(1), F.lit(2)))
    detail = src.select("product_id", languages.alias("language_id"), "title", "text").withColumn("position", F.col("language_id"))
    service = src.select("product_id", "type_code", "locality_id", F.lit(0).alias("included"), F.lit(1).alias("position"),
                         F.col("text").alias("description"), "place")
    if service_type_ids is not None:
        service = service.join(service_type_ids, "type_code")
    return {"product": product, "detail": detail, "service": service}
