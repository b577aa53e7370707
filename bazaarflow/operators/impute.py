"""Exact medians per group and the price ladder over coarser groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarflow.session import materialise

BUCKETS = 1024
MAX_VALUES = 200_000


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))


def _middle_range(part: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """Keeps the values of the equal-width steps that hold the middle ranks, and counts what lies before them."""
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    stats = part.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    width = F.nullif((F.col("_hi") - F.col("_lo")).cast("double"), F.lit(0.0))
    step = F.least(F.floor((F.col("_v") - F.col("_lo")) / width * buckets), F.lit(buckets - 1))
    placed = part.join(stats, keys).withColumn("_b", F.coalesce(step, F.lit(0)).cast("int")).drop("_lo", "_hi")
    histogram = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"), F.first("_n").alias("_n"), F.first("_before").alias("_before"))
    running = Window.partitionBy(*keys).orderBy("_b")  # at most ``buckets`` rows per key
    end = F.col("_before") + F.sum("_bc").over(running)
    middle = (histogram.withColumn("_end", end).where((F.col("_end") > low) & (F.col("_end") - F.col("_bc") <= high))
              .groupBy(*keys).agg(F.min("_b").alias("_b1"), F.max("_b").alias("_b2"),
                                  F.min(F.col("_end") - F.col("_bc")).alias("_new")))
    return (placed.join(middle, keys).where(F.col("_b").between(F.col("_b1"), F.col("_b2")))
            .select(*keys, "_v", "_c", "_n", F.col("_new").alias("_before")))


def median_of_counts(counts: DataFrame, keys: Sequence[str], out: str = "median", buckets: int = BUCKETS,
                     max_values: int = MAX_VALUES) -> DataFrame:
    """Exact interpolated median per group from (keys, _v, _c).

    Distinct values are ranked in one window per group only while no group has more than ``max_values`` of
    them. Larger groups are first narrowed to the steps around their middle, as often as it takes.
    """
    keys = list(keys)
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    part = materialise(counts.join(totals, keys).withColumn("_before", F.lit(0).cast("bigint")), "values")
    while (part.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > max_values:
        part = materialise(_middle_range(part, keys, buckets), "values")
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    end = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v"))
    ranked = part.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_c"))
    value = F.col("_v").cast("double")
    at_low = F.min(F.when((F.col("_start") <= low) & (F.col("_end") > low), value))
    at_high = F.min(F.when((F.col("_start") <= high) & (F.col("_end") > high), value))
    return ranked.groupBy(*keys).agg(((at_low + at_high) / 2).alias(out))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    return median_of_counts(value_counts(df, keys, value), keys, out)


def price_reference(reference: DataFrame, city: str, country: str, activity: str, price: str) -> list[DataFrame]:
    """Median tables for (city, type), (country, type) and type, of positive prices.

    The value counts of the finest grouping are computed once and summed up for the coarser ones.
    """
    base = (reference.where(F.col(price) > 0)
            .select(F.lower(city).alias("_city"), F.lower(country).alias("_country"), F.col(activity).alias("_type"),
                    F.col(price).alias("_v"))
            .groupBy("_city", "_country", "_type", "_v").agg(F.count("*").alias("_c")))
    base = materialise(base, "price-counts")
    out = []
    for keys in (["_city", "_type"], ["_country", "_type"], ["_type"]):
        counts = base
        for k in keys:
            counts = counts.where(F.col(k).isNotNull())
        counts = counts.groupBy(*keys, "_v").agg(F.sum("_c").alias("_c"))
        out.append(materialise(median_of_counts(counts, keys, "_m"), "medians"))
    return out


def fill_prices(df: DataFrame, reference: DataFrame, *, price: str = "price", flag: str = "price_is_estimated",
                city: str = "city", country: str = "country", activity: str = "activity", ref_city: str = "city",
                ref_country: str = "country", ref_activity: str = "activity", ref_price: str = "price",
                last_resort: Column | None = None, digits: int = 2) -> DataFrame:
    """Fills null or zero prices from the first level that has a median, then from ``last_resort``.

    Adds ``price_level`` (0 stated, 1-3 ladder, 4 last resort, null when nothing was found).
    """
    tables = price_reference(reference, ref_city, ref_country, ref_activity, ref_price)
    missing = F.col(price).isNull() | (F.col(price) == 0)
    out = df.withColumn("_missing", missing)
    joins = [[(city, "_city"), (activity, "_type")], [(country, "_country"), (activity, "_type")], [(activity, "_type")]]
    for n, (table, keys) in enumerate(zip(tables, joins), 1):
        named = table.select(*[F.col(t).alias(f"_j{n}{t}") for _, t in keys], F.round("_m", digits).alias(f"_m{n}"))
        cond = F.col("_missing")
        for left, t in keys:
            value = F.col(left) if t == "_type" else F.lower(left)
            cond = cond & (value == F.col(f"_j{n}{t}"))
        out = out.join(named, cond, "left").drop(*[f"_j{n}{t}" for _, t in keys])
    last = last_resort if last_resort is not None else F.lit(None).cast("double")
    level = (F.when(~F.col("_missing"), 0).when(F.col("_m1").isNotNull(), 1).when(F.col("_m2").isNotNull(), 2)
             .when(F.col("_m3").isNotNull(), 3).when(last.isNotNull(), 4))
    filled = F.when(~F.col("_missing"), F.col(price).cast("double")).otherwise(F.coalesce("_m1", "_m2", "_m3", last))
    return (out.withColumn("price_level", level).withColumn(price, filled)
            .withColumn(flag, F.when(F.col("_missing"), F.lit(True)).otherwise(F.col(flag)) if flag in df.columns
                        else F.col("_missing"))
            .drop("_missing", "_m1", "_m2", "_m3"))
