"""Search query and marketplace rows from countries and cities: literal lists are exploded, nothing is cross joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarflow import vocab


def fill(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def country_queries(countries: DataFrame, country: str, templates: Sequence[str],
                    regional: Sequence[tuple[Sequence[str], Sequence[str]]] = ()) -> DataFrame:
    """One row per country and template; regional templates only for the countries of their list. Distinct."""
    low = F.lower(F.col(country))
    lists = [F.array(*map(F.lit, templates))]
    for members, extra in regional:
        lists.append(F.when(low.isin(*members), F.array(*map(F.lit, extra))).otherwise(F.array().cast("array<string>")))
    queries = F.array_distinct(F.transform(F.concat(*lists), lambda t: fill(t, country=F.col(country))))
    return countries.select("*", F.explode(queries).alias("query"))


def marketplace_suppliers(required: DataFrame, cities: str, existing: DataFrame,
                          marketplaces=vocab.MARKETPLACES) -> DataFrame:
    """Marketplace rows for the required cities (a map country → cities); known hosts are left out.

    The first city, in (country, position) order, that reaches a host gets it.
    """
    from bazaarflow.functions.text import host

    city = (required.select(F.explode(F.col(cities)).alias("country", "_list"))
            .select("country", F.posexplode("_list").alias("pos", "city")))
    items = F.array(*[F.struct(F.lit(n).alias("marketplace"), F.lit(u).alias("template")) for n, u in marketplaces])
    rows = city.select("country", "pos", "city", F.inline(items))
    plus = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("+"))
    rows = (rows.withColumn("url", fill(F.col("template"), city=plus("city"), country=plus("country")))
            .withColumn("domain", host(F.col("url"))).drop("template")
            .withColumn("name", F.concat(F.initcap("marketplace"), F.lit(" — "), F.col("city"))))
    rows = rows.join(existing.select("domain"), "domain", "left_anti")
    best = rows.groupBy("domain").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "domain"]),
                                               F.struct("country", "pos")).alias("r"))
    return best.select("domain", "r.*").withColumn("score", F.lit(60)).withColumn("connection", F.lit("MARKETPLACE"))
