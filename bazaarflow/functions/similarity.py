"""Similarity scores between two products, each in [0, 1]."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarflow import vocab
from bazaarflow.functions.rules import has_any, lit_array
from bazaarflow.functions.text import ascii_words, fold, present


def _jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / union).otherwise(F.lit(0.0))


def transfer_direction(title: Column) -> Column:
    """ARRIVAL (airport to city), DEPARTURE (city to airport) or UNKNOWN."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return (F.when(low.rlike(r"airport.*?\bto\b"), "ARRIVAL").when(low.rlike(r"\bto\b.*?airport"), "DEPARTURE")
            .when(has_any(low, ["arrival transfer", "arriving", "from airport", "airport pickup"]), "ARRIVAL")
            .when(has_any(low, ["departure transfer", "departing", "to airport", "airport dropoff", "drop-off"]),
                  "DEPARTURE")
            .otherwise("UNKNOWN"))


def title_words(title: Column, stop=vocab.TITLE_STOP) -> Column:
    """Keywords of a title, "from" among them: it tells the direction of a transfer."""
    return F.array_except(ascii_words(F.coalesce(title, F.lit("")), 3), lit_array(stop))


def title_features(title: Column, title_en: Column | None = None, direction=vocab.DIRECTION_STOP) -> Column:
    """What the title score needs of one side: both word sets, direction, and the lower-case titles."""
    words, way = title_words(title), transfer_direction(title)
    texts = [F.lower(F.coalesce(title, F.lit("")))]
    if title_en is not None:
        words = F.array_union(words, title_words(title_en))
        way = F.when(way == "UNKNOWN", transfer_direction(title_en)).otherwise(way)
        texts.append(F.lower(F.coalesce(title_en, F.lit(""))))
    return F.struct(words.alias("all"), F.array_except(words, lit_array(direction)).alias("plain"),
                    way.alias("way"), F.array(*texts).alias("texts"))


def title_score_of(left: Column, right: Column, activity: Column) -> Column:
    """Word overlap with the union of both catalogue titles, +0.1 when one is contained.

    Opposite transfer directions give 0.1. ``left`` and ``right`` are title_features.
    """
    is_transfer = F.coalesce(activity == "TRANSFER", F.lit(False))
    opposite = (is_transfer & (left["way"] != "UNKNOWN") & (right["way"] != "UNKNOWN") & (left["way"] != right["way"]))
    a = F.when(is_transfer, left["all"]).otherwise(left["plain"])
    b = F.when(is_transfer, right["all"]).otherwise(right["plain"])
    contained = F.exists(right["texts"], lambda t: (t != "") & F.contains(left["texts"][0], t))
    score = F.least(_jaccard(a, b) + F.when(contained, 0.1).otherwise(0.0), F.lit(1.0))
    return F.when(opposite, F.lit(0.1)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(score)


def title_score(left: Column, right: Column, right_en: Column, activity: Column) -> Column:
    """Title score of two titles (features computed on the spot)."""
    return title_score_of(title_features(left), title_features(right, right_en), activity)


def description_words(c: Column) -> Column:
    return ascii_words(F.coalesce(c, F.lit("")), 4)


def word_overlap(a: Column, b: Column) -> Column:
    return _jaccard(a, b)


def description_score(left: Column, right: Column) -> Column:
    return _jaccard(description_words(left), description_words(right))


def place_features(c: Column) -> Column:
    """A place name as compared: null when missing, lower case, and without accents."""
    named = F.when(present(F.coalesce(c, F.lit(""))), F.trim(c))
    return F.struct(F.lower(named).alias("low"), F.lower(fold(named)).alias("plain"))


def country_score_of(left: Column, right: Column) -> Column:
    missing = left["low"].isNull() | right["low"].isNull()
    return F.when(missing, 0.5).when(left["plain"] == right["plain"], 1.0).otherwise(0.0)


def country_score(left: Column, right: Column) -> Column:
    return country_score_of(place_features(left), place_features(right))


def category_features(c: Column, groups=vocab.CATEGORY_GROUPS, related=vocab.RELATED_CATEGORIES) -> Column:
    """A category as compared, and the numbers of the equivalence and related groups it belongs to."""
    key = F.nullif(F.upper(F.trim(c)), F.lit(""))

    def members(lists) -> Column:
        words: dict[str, list[int]] = {}
        for n, names in enumerate(lists):
            for name in dict.fromkeys(names):
                words.setdefault(name, []).append(n)
        table = F.create_map(*[x for w, ns in words.items() for x in (F.lit(w), lit_array(ns))])
        return F.coalesce(F.try_element_at(table, key), F.array().cast("array<int>"))

    return F.struct(key.alias("key"), members([[n, *w] for n, w in groups]).alias("groups"), members(related).alias("near"))


def category_score_of(left: Column, right: Column) -> Column:
    missing = left["key"].isNull() | right["key"].isNull()
    return (F.when(missing, 0.3).when(left["key"] == right["key"], 1.0)
            .when(F.arrays_overlap(left["groups"], right["groups"]), 0.8)
            .when(F.arrays_overlap(left["near"], right["near"]), 0.6).otherwise(0.0))


def category_score(left: Column, right: Column) -> Column:
    return category_score_of(category_features(left), category_features(right))


def price_score(left: Column, right: Column) -> Column:
    ratio = F.greatest(left, right) / F.nullif(F.least(left, right), F.lit(0.0))
    usable = F.coalesce((left > 0) & (right > 0), F.lit(False))
    return (F.when(~usable, 0.5).when(ratio <= 1.3, 1.0).when(ratio <= 2.0, 0.7).when(ratio <= 3.0, 0.4)
            .otherwise(0.1))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 for empty or zero vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = norm(a) * norm(b)
    return F.when(F.coalesce(size > 0, F.lit(False)), dot / size).otherwise(F.lit(0.0))


def city_score_native(left: Column, right: Column) -> Column:
    """City score of two place_features where no edit comparison is needed; null where it is."""
    a, b = left["plain"], right["plain"]
    missing = left["low"].isNull() | right["low"].isNull()
    inside = (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    return F.when(missing, 0.0).when(left["low"] == right["low"], 1.0).when(a == b, 1.0).when(inside, 0.85)


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit ratio of the given pairs, once per distinct pair of the batch; null where a side is null."""
    known: dict = {}
    for pair in zip(a, b):
        if pair not in known:
            known[pair] = None if pair[0] is None or pair[1] is None else difflib.SequenceMatcher(None, *pair).ratio()
    return pd.Series([known[p] for p in zip(a, b)], dtype="float64")


def city_score_from(pairs: DataFrame, left: str, right: str, out: str = "city_score") -> DataFrame:
    """Adds the city score of two place_features columns.

    The edit ratio has no native form; only pairs the native steps leave open reach it.
    """
    scored = pairs.withColumn("_native", city_score_native(F.col(left), F.col(right)))
    still = F.col("_native").isNull()
    scored = scored.withColumn("_r", _ratio(F.when(still, F.col(left)["plain"]), F.when(still, F.col(right)["plain"])))
    band = (F.when(F.col("_r") >= 0.80, 1.0).when(F.col("_r") >= 0.65, 0.85).when(F.col("_r") >= 0.50, 0.60).otherwise(0.0))
    return scored.withColumn(out, F.coalesce("_native", band)).drop("_native", "_r")


def with_city_score(pairs: DataFrame, left: str, right: str, out: str = "city_score") -> DataFrame:
    """Adds the city score of two city columns."""
    staged = pairs.withColumns({"_a": place_features(F.col(left)), "_b": place_features(F.col(right))})
    return city_score_from(staged, "_a", "_b", out).drop("_a", "_b")


def composite(title: Column, city: Column, country: Column, description: Column, category: Column, price: Column,
              vector: Column, weights=vocab.MATCH_WEIGHTS, blend=vocab.MATCH_BLEND) -> Column:
    w = weights
    dims = (title * w["title"] + city * w["city"] + country * w["country"] + description * w["description"]
            + category * w["category"] + price * w["price"])
    return F.round(dims * blend["dimensions"] + vector * blend["vector"], 4)


def decision(score: Column, threshold: float = vocab.DUPLICATE_THRESHOLD) -> Column:
    """struct(status, type)."""
    similar = F.coalesce(score >= threshold, F.lit(False))
    return F.struct(F.when(similar, "SIMILAR").otherwise("NEW_PRODUCT").alias("status"),
                    F.when(similar, "AUTO_REJECT").otherwise("AUTO_ACCEPT").alias("type"))


def structured_score(l, r, vector: Column, flag_names, weights=vocab.STRUCTURED_WEIGHTS) -> Column:
    """Weighted service, route, city, theme, flag and vector agreement.

    ``l`` and ``r`` map attribute names to the columns of the two sides.
    """
    def equal(name, ignore_case=True):
        a, b = l[name], r[name]
        both = present(F.coalesce(a, F.lit(""))) & present(F.coalesce(b, F.lit("")))
        return F.coalesce(both & ((F.lower(a) == F.lower(b)) if ignore_case else (a == b)), F.lit(False))

    def given(name):
        return present(F.coalesce(l[name], F.lit(""))) & present(F.coalesce(r[name], F.lit("")))

    service = F.when(l["service_type"].eqNullSafe(r["service_type"]), 1.0).otherwise(0.0)
    # Without an origin on both sides the destination is not looked at.
    partial = F.when(given("origin") & equal("origin"), 0.7).when(given("origin") & equal("destination"), 0.7).otherwise(0.0)
    both_transfer = F.coalesce((l["service_type"] == "TRANSFER") & (r["service_type"] == "TRANSFER"), F.lit(False))
    route = (F.when(given("route"), F.when(equal("route"), 1.0).otherwise(partial)).when(both_transfer, 0.3)
             .otherwise(0.0))
    city = (F.when(given("city"), F.when(equal("city"), 1.0)
                   .when(l["country"].eqNullSafe(r["country"]), 0.5).otherwise(0.0)).otherwise(0.0))
    theme = F.when(l["family"].eqNullSafe(r["family"]),
                   F.when(l["subtype"].eqNullSafe(r["subtype"]), 1.0).otherwise(0.7)).otherwise(0.0)
    agree = sum((F.coalesce(l[f], F.lit(False)) == F.coalesce(r[f], F.lit(False))).cast("int") for f in flag_names)
    w = weights
    return (service * w["service_type"] + route * w["route"] + city * w["city"] + theme * w["theme"]
            + agree / F.lit(len(flag_names)) * w["flags"] + F.coalesce(vector, F.lit(0.0)) * w["embedding"])


def structured_decision(score: Column, match=vocab.STRUCTURED_MATCH, review=vocab.STRUCTURED_REVIEW,
                        exact=vocab.STRUCTURED_EXACT) -> Column:
    """struct(status, type): three-way decision and how the match was made."""
    matched = F.coalesce(score >= review, F.lit(False))
    return F.struct(
        F.when(score >= match, "MATCHED").when(score >= review, "REVIEW_REQUIRED").otherwise("NEW_PRODUCT").alias("status"),
        F.when(matched & (score >= exact), "STRUCTURED_MATCH").when(matched, "SEMANTIC_MATCH")
        .otherwise("NEW_PRODUCT").alias("type"))
