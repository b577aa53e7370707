"""Keyed lookups against dimension tables (countries, cities, codes)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarflow.session import materialise


def norm_key(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def first_by(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """One row per key: the values of the row with the lowest ``order``.

    Meant for dimensions: the result is written out, so that a join knows how small it is.
    """
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("_v"))
    return materialise(best.select(*keys, "_v.*"), "dimension")


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``done`` (null keys in ``done`` are ignored)."""
    return df.join(done.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def present_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_semi")


def lookup(df: DataFrame, key: Column, dim: DataFrame, dim_key: Column, values: Sequence[tuple[str, str]],
           order: str) -> DataFrame:
    """Left lookup ignoring case and outer blanks; the first dimension row by ``order`` wins.

    ``values``: (dimension column, output column). Works on the distinct dimension keys, so it never fans out.
    """
    table = (dim.withColumn("_k", norm_key(dim_key)).where("_k is not null")
             .groupBy("_k").agg(F.min_by(F.struct(*[F.col(c).alias(out) for c, out in values]), order).alias("_v"))
             .select("_k", "_v.*"))
    table = materialise(table, "dimension")
    return df.withColumn("_key", norm_key(key)).join(table, F.col("_key") == F.col("_k"), "left").drop("_key", "_k")


def verify_city(df: DataFrame, city: str, country: str, cities: DataFrame, out: str = "verified") -> DataFrame:
    """City name as the gazetteer writes it: exact in the country, exact anywhere, or as a name's beginning.

    ``cities``: city_id, name, country. The prefix step joins on the beginnings of the gazetteer names
    instead of comparing every pair.
    """
    named = cities.withColumn("_n", F.lower("name"))
    in_country = first_by(named.withColumn("_c", F.lower("country")), ["_n", "_c"], "city_id", ["name"]) \
        .withColumnRenamed("name", "_in")
    anywhere = first_by(named, ["_n"], "city_id", ["name"]).withColumnRenamed("name", "_any")
    starts = first_by(
        named.select("city_id", "name", F.explode(F.transform(
            F.sequence(F.lit(2), F.greatest(F.length("_n"), F.lit(2))), lambda n: F.substring(F.col("_n"), F.lit(1), n)))
            .alias("_p")), ["_p"], "city_id", ["name"]).withColumnRenamed("name", "_start")
    key = F.when(F.length(F.trim(F.col(city))) >= 2, F.lower(F.trim(F.col(city))))
    wanted = df.select(key.alias("_key"), F.lower(F.col(country)).alias("_kc")).where("_key is not null").distinct()
    found = (wanted.join(in_country, (F.col("_key") == F.col("_n")) & (F.col("_kc") == F.col("_c")), "left").drop("_n", "_c")
             .join(anywhere, F.col("_key") == F.col("_n"), "left").drop("_n")
             .join(starts, F.col("_key") == F.col("_p"), "left")
             .select("_key", "_kc", F.coalesce("_in", "_any", "_start").alias(out)))
    found = materialise(found, "cities")
    return (df.withColumn("_k", key).withColumn("_kk", F.lower(F.col(country)))
            .join(found, (F.col("_k") == F.col("_key")) & F.col("_kk").eqNullSafe(F.col("_kc")), "left")
            .drop("_k", "_kk", "_key", "_kc"))


def validate_place(df: DataFrame, city: str, country: str, countries: DataFrame, cities: DataFrame) -> DataFrame:
    """Adds city_valid, country_valid, canonical_city, canonical_country, boost (+.2 country, +.3 city)."""
    out = lookup(df, F.col(country), countries, F.col("country"), [("country", "canonical_country")], "country_id")
    named = cities.withColumn("_n", F.lower("name"))
    in_country = first_by(named.withColumn("_c", F.lower("country")), ["_n", "_c"], "city_id", ["name"]) \
        .withColumnRenamed("name", "_in")
    anywhere = first_by(named, ["_n"], "city_id", ["name"]).withColumnRenamed("name", "_any")
    out = out.withColumn("_k", norm_key(F.col(city))).withColumn("_kc", F.lower("canonical_country"))
    out = (out.join(in_country, (F.col("_k") == F.col("_n")) & (F.col("_kc") == F.col("_c")), "left").drop("_n", "_c")
           .join(anywhere, F.col("_k") == F.col("_n"), "left").drop("_n"))
    name = F.when(F.col("canonical_country").isNotNull(), F.col("_in")).otherwise(F.col("_any"))
    return (out.withColumn("canonical_city", name)
            .withColumn("country_valid", F.col("canonical_country").isNotNull())
            .withColumn("city_valid", F.col("canonical_city").isNotNull())
            .withColumn("boost", F.round(F.when(F.col("country_valid"), 0.2).otherwise(0.0)
                                         + F.when(F.col("city_valid"), 0.3).otherwise(0.0), 2))
            .drop("_k", "_kc", "_in", "_any"))


def ground_place(df: DataFrame, destination: str, country: str, countries: DataFrame, cities: DataFrame) -> DataFrame:
    """Adds grounded_city and grounded_country.

    The country must be known. An attraction is no city. A city the gazetteer does not know stays as a hint.
    """
    from bazaarflow.functions.text import is_attraction

    long_country = F.when(F.length(F.trim(F.col(country))) > 1, F.col(country))
    out = lookup(df, long_country, countries, F.col("country"), [("country", "grounded_country")], "country_id")
    named = cities.withColumn("_n", F.lower("name"))
    in_country = first_by(named.withColumn("_c", F.lower("country")), ["_n", "_c"], "city_id", ["name"]) \
        .withColumnRenamed("name", "_in")
    anywhere = first_by(named, ["_n"], "city_id", ["name"]).withColumnRenamed("name", "_any")
    wanted = F.trim(F.col(destination))
    out = out.withColumn("_k", F.lower(wanted)).withColumn("_kc", F.lower("grounded_country"))
    out = (out.join(in_country, (F.col("_k") == F.col("_n")) & (F.col("_kc") == F.col("_c")), "left").drop("_n", "_c")
           .join(anywhere, F.col("_k") == F.col("_n"), "left").drop("_n"))
    name = F.when(F.col("grounded_country").isNotNull(), F.col("_in")).otherwise(F.col("_any"))
    usable = (F.length(wanted) > 2) & ~is_attraction(wanted)
    return out.withColumn("grounded_city", F.when(usable, F.coalesce(name, wanted))).drop("_k", "_kc", "_in", "_any")


def cities_of(countries_wanted: DataFrame, cities: DataFrame) -> DataFrame:
    """Distinct cities per wanted country name; names found only as part of a country name come second.

    ``countries_wanted``: wanted. Returns wanted, city. A name no country contains keeps itself as its city.
    The part-of test runs on distinct country names through their substrings of the wanted lengths.
    """
    wanted = countries_wanted.select("wanted").distinct()
    pairs = cities.select("country", F.col("name").alias("city")).distinct()
    names = pairs.select("country").distinct().withColumn("_c", F.lower("country"))
    exact = wanted.join(names, F.lower("wanted") == F.col("_c")).select("wanted", "country")
    parts = names.select("country", F.explode(F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.length("_c")), lambda i: F.transform(
            F.sequence(F.lit(1), F.length(F.col("_c")) - i + 1), lambda n: F.substring(F.col("_c"), i, n)))))).alias("_p"))
    rest = wanted.join(exact, "wanted", "left_anti")
    partial = rest.join(parts, F.lower("wanted") == F.col("_p")).select("wanted", "country")
    found = exact.unionByName(partial).join(pairs, "country").select("wanted", "city").distinct()
    unknown = wanted.join(found, "wanted", "left_anti").select("wanted", F.col("wanted").alias("city"))
    return found.unionByName(unknown)


def get_or_create(df: DataFrame, name: str, localities: DataFrame, *, name_columns: Sequence[str] = ("name",),
                  iso: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Gives every row a locality id; returns (rows with locality_id, new locality rows).

    New localities get an id hashed from their name, so a repeated run gives the same id. Rows without a
    name take the lowest existing id, or 1 when there is none.
    """
    keys = None
    for column in name_columns:
        part = localities.select(norm_key(F.col(column)).alias("_k"), "locality_id").where("_k is not null")
        keys = part if keys is None else keys.unionByName(part)
    keys = materialise(keys.groupBy("_k").agg(F.min("locality_id").alias("_id")), "localities")
    default = localities.agg(F.coalesce(F.min("locality_id"), F.lit(1)).alias("_default"))
    out = df.withColumn("_key", norm_key(F.col(name))).join(keys, F.col("_key") == F.col("_k"), "left").drop("_k")
    out = out.join(F.broadcast(default))  # exactly one row
    made = F.xxhash64("_key")
    rows = out.withColumn("locality_id", F.when(F.col("_key").isNull(), F.col("_default"))
                          .otherwise(F.coalesce("_id", made)))
    fresh = rows.where(F.col("_key").isNotNull() & F.col("_id").isNull())
    new = fresh.groupBy("locality_id").agg(
        F.min(F.col(name)).alias("name"), F.min(iso if iso is not None else F.lit(None).cast("string")).alias("iso"))
    return rows.drop("_key", "_id", "_default"), new
