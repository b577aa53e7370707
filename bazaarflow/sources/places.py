"""Landed JSON of place, search and geocoder services in common schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarflow import vocab
from bazaarflow.functions.rules import has_any
from bazaarflow.functions.text import host

PLACE_FIELDS = ["name", "title", "type", "category", "website", "site", "url", "address", "full_address", "phone",
                "rating", "reviews", "review_count", "link", "maps_url"]
PLACE_SCHEMA = ("struct<" + ",".join(f"{f}:string" for f in PLACE_FIELDS)
                + ",phone_numbers:array<string>,phones:array<string>>")


def _first(item: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(item[n], F.lit("")) for n in names])


def _place(df: DataFrame, json: str, vendor: str) -> DataFrame:
    df = df.withColumn("_i", F.from_json(json, PLACE_SCHEMA))
    i = F.col("_i")
    if vendor == "maps":
        name, site = _first(i, "name", "title"), _first(i, "website", "site", "url")
        address, reviews, link = _first(i, "full_address", "address"), _first(i, "review_count", "reviews"), _first(i, "maps_url", "url")
        phone = F.coalesce(F.get(F.coalesce(i["phone_numbers"], i["phones"]), F.lit(0)), i["phone"])
    else:
        name, site = _first(i, "title", "name"), _first(i, "website", "url")
        address, reviews, link = _first(i, "address"), _first(i, "reviews"), _first(i, "link", "maps_url")
        phone = i["phone"]
    blank = F.lit("")
    return df.select(
        *[c for c in df.columns if c not in (json, "_i")], F.trim(name).alias("name"), host(site).alias("domain"),
        F.coalesce(address, blank).alias("address"), F.coalesce(phone, blank).alias("phone"),
        i["rating"].try_cast("double").alias("rating"), F.coalesce(reviews.try_cast("int"), F.lit(0)).alias("reviews"),
        F.coalesce(_first(i, "type", "category"), blank).alias("category"), F.coalesce(link, blank).alias("maps_url"),
        F.lit(vendor).alias("source"))


def usable_places(df: DataFrame, json: str, vendor: str, skip=vocab.SEARCH_SKIP_DOMAINS,
                  categories=vocab.SKIP_CATEGORIES) -> DataFrame:
    """Places of one vendor ("maps" or "local") with a name, a host and no software category."""
    return _place(df, json, vendor).where(
        (F.coalesce(F.col("name"), F.lit("")) != "") & ~has_any(F.lower("category"), categories)
        & (F.length("domain") >= 4) & ~has_any(F.col("domain"), skip))


def all_places(maps: DataFrame, local: DataFrame, json: str) -> DataFrame:
    return usable_places(maps, json, "maps").unionByName(usable_places(local, json, "local"))


GEOCODER_SCHEMA = ("array<struct<name:string,address:struct<city:string,town:string,village:string,municipality:string,"
                   "suburb:string>>>")


def city_names(df: DataFrame, json: str, keys: Sequence[str] = (), bad_words: Sequence[str] = (),
               bad_phrases=vocab.BAD_PLACE_PHRASES) -> DataFrame:
    """Distinct clean city names (ignoring case) per key from geocoder replies, first spelling by name order."""
    item = df.select(*keys, F.explode(F.from_json(json, GEOCODER_SCHEMA)).alias("i"))
    a = F.col("i.address")
    name = F.trim(F.coalesce(*[F.nullif(a[f], F.lit("")) for f in ("city", "town", "village", "municipality", "suburb")],
                             F.col("i.name")))
    low = F.lower(F.col("city"))
    good = item.withColumn("city", name).where(
        F.length("city").between(2, 80) & ~low.isin(*(bad_words or [""])) & ~has_any(low, bad_phrases))
    return good.groupBy(*keys, low.alias("_k")).agg(F.min("city").alias("city")).drop("_k")


SEARCH_SCHEMA = "array<struct<title:string,link:string,url:string,snippet:string>>"


def search_results(df: DataFrame, json: str, keys: Sequence[str] = (), skip=vocab.SEARCH_SKIP_DOMAINS) -> DataFrame:
    """title, link, snippet, domain rows of search replies (organic_results, results or items)."""
    listed = F.coalesce(*[F.get_json_object(json, f"$.{n}") for n in ("organic_results", "results", "items")],
                        F.when(F.trim(F.col(json)).startswith("["), F.col(json)))
    item = df.select(*keys, F.explode(F.from_json(listed, SEARCH_SCHEMA)).alias("i"))
    link = F.coalesce(F.nullif(F.col("i.link"), F.lit("")), F.col("i.url"))
    rows = item.select(*keys, F.trim("i.title").alias("title"), link.alias("link"),
                       F.coalesce(F.col("i.snippet"), F.lit("")).alias("snippet"), host(link).alias("domain"))
    return rows.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("link", F.lit("")) != "")
                      & ~has_any(F.col("domain"), skip))
