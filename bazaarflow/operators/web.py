"""Page-table jobs: validated products, lead qualification, extraction result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarflow import vocab
from bazaarflow.functions import pages, text
from bazaarflow.functions.money import parse_shop_price
from bazaarflow.functions.rules import first_label, has_any
from bazaarflow.operators.lookup import ground_place


def validated_products(items: DataFrame, countries: DataFrame, cities: DataFrame, *, page: str = "page_id", pos: str = "pos",
                       page_url: str = "page_url", rules=vocab.EXTRACT_ACTIVITY_RULES) -> DataFrame:
    """Raw products from extracted items: title gate, one row per title and page, price, type, place.

    ``items``: page id, position, page URL and the item columns title, description, activity, destination,
    country, price_text, url, duration.
    """
    named = items.withColumn("title", text.drop_control(F.trim(F.coalesce("title", F.lit("")))))
    good = named.where((F.col("title") != "") & ~pages.is_garbage_title(F.col("title")))
    others = [c for c in good.columns if c not in (page, "title")]
    first = good.groupBy(page, "title").agg(F.min_by(F.struct(*others), pos).alias("r")).select(page, "title", "r.*")
    price = parse_shop_price(F.col("price_text"))
    stated = F.upper(F.trim(F.coalesce("activity", F.lit(""))))
    body = F.lower(F.concat_ws(" ", "title", F.coalesce("description", F.lit(""))))
    out = (first.withColumn("amount", price["amount"]).withColumn("currency", price["currency"])
           .withColumn("activity", F.when(stated.isin(*pages.ACTIVITIES), stated).otherwise(first_label(body, rules, "EXCURSION")))
           .withColumn("country", F.coalesce(text.blank_to_null(F.col("country")), pages.country_of_path(F.col(page_url))))
           .withColumn("description", F.nullif(text.drop_control(F.trim("description")), F.lit("")))
           .withColumn("duration", F.nullif(F.trim("duration"), F.lit("")))
           .withColumn("url", F.nullif(F.coalesce(text.blank_to_null(F.col("url")), F.col(page_url)), F.lit(""))))
    return ground_place(out, "destination", "country", countries, cities)


def qualify_leads(places: DataFrame, pages_by_host: DataFrame, *, cities=(), not_words=vocab.NOT_SUPPLIER_WORDS,
                  skip=vocab.SKIP_DOMAINS, min_html: int | None = None) -> DataFrame:
    """Connected suppliers among places, scored by their page.

    ``places``: seq, name, url, description, address. ``pages_by_host``: host, html, one row per host. The
    first place per host counts. A page worth 50 points or more proves a channel. Places whose page is
    missing, or shorter than ``min_html`` where that is given, score 0.
    """
    leads = places.withColumn("domain", text.host(F.col("url"))).where(
        (F.length("name") >= 3) & ~has_any(F.lower("name"), not_words) & (F.length("domain") >= 5)
        & ~has_any(F.col("domain"), skip) & pages.is_travel_supplier(F.col("name"), F.col("domain")))
    # Pages are scored before the join, so their text is not shuffled with the places.
    long_enough = pages_by_host if min_html is None else pages_by_host.where(F.length("html") >= min_html)
    scored = (long_enough
              .withColumns({"_s": pages.supplier_signals(F.col("html"), cities), "_geo": pages.embedded_geo(F.col("html"))})
              .select("host", F.col("_s.score").alias("_score"), "_geo"))
    wide = (leads.join(scored, F.col("domain") == F.col("host"), "left").withColumn("score", F.coalesce("_score", F.lit(0)))
            .withColumn("_link", pages.connection(F.concat_ws(" ", "name", "description", "domain"))))
    street = F.nullif(F.trim(F.get(F.split("address", ","), F.lit(0))), F.lit(""))
    has_channel = F.col("_link.has_channel") | (F.col("score") >= 50)
    out = wide.select("seq", "name", "domain", "score", F.col("_link.has_api").alias("has_api"), has_channel.alias("has_channel"),
                      F.col("_link.channel_name").alias("channel_name"),
                      pages.connection_type(F.col("_link.has_api"), has_channel).alias("connection"),
                      F.col("_geo.country").alias("country"), F.coalesce(F.col("_geo.city"), street).alias("city"))
    connected = out.where(pages.is_connected(F.col("has_api"), F.col("has_channel")))
    first = connected.groupBy("domain").agg(F.min_by(F.struct(*[c for c in out.columns if c != "domain"]), "seq").alias("r"))
    return first.select("domain", "r.*")


def result_rows(extractions: DataFrame, *, keys, items: str = "items", error: str = "error", city: str = "page_city",
                country: str = "page_country") -> DataFrame:
    """One row per item with status ok; a page without items gives one row, no_products or error.

    ``items``: array of struct(title, description, price_raw, category, activity, city, country, url).
    """
    rows = extractions.select(*keys, error, city, country, F.explode_outer(items).alias("i"))
    failed, empty = F.col(error).isNotNull(), F.col("i").isNull()
    activity = F.upper(F.trim(F.coalesce(F.col("i.activity"), F.lit("EXCURSION"))))
    return rows.select(
        *keys, F.when(failed, "error").when(empty, "no_products").otherwise("ok").alias("status"),
        F.when(~failed, F.col("i.title")).alias("title"), F.when(~failed, F.col("i.price_raw")).alias("price_raw"),
        F.when(~failed & ~empty, F.when(activity.isin(*pages.ACTIVITIES), activity).otherwise(F.lit("EXCURSION"))).alias("activity"),
        F.coalesce(text.blank_to_null(F.col("i.city")), text.blank_to_null(F.col(city))).alias("city"),
        F.coalesce(text.blank_to_null(F.col("i.country")), text.blank_to_null(F.col(country))).alias("country"),
        F.col("i.url").alias("url"))
