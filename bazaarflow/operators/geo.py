"""Place resolution: mentions in text, gazetteer ladder, exonyms, address parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarflow import vocab
from bazaarflow.functions.rules import has_any, one_of
from bazaarflow.functions.text import blank_to_null, word_count
from bazaarflow.operators.lookup import first_by, lookup
from bazaarflow.operators.trigram import best_city
from bazaarflow.session import materialise


def is_garbage_city(city: Column, words=vocab.GARBAGE_CITY_WORDS, countries=vocab.COUNTRY_AS_CITY,
                    attractions=vocab.CITY_ATTRACTION_WORDS) -> Column:
    low = F.lower(F.trim(city))
    short = F.coalesce(F.length(low) <= 2, F.lit(True))
    return short | one_of(low, [*words, *countries]) | (has_any(low, attractions) & (word_count(low) > 1))


def words_of(text: Column) -> Column:
    """Lower-case words; apostrophes and hyphens belong to them."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}'-]+"), lambda w: w != "")


def phrase_of(text: Column) -> Column:
    return F.array_join(words_of(text), " ")


def dictionary_scan(df: DataFrame, key: str, text: str, phrases: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Every place of a text at which a phrase of the dictionary stands: key, ``carry``, pos, n, phrase.

    ``phrases``: distinct ``phrase`` (``phrase_of``). A word goes on only if a phrase begins with it, with the lengths such
    phrases have; so a text gives one row a word, not one for every run of words, and is itself never copied.
    """
    size = F.size(F.split("phrase", " "))
    firsts = phrases.groupBy(F.substring_index("phrase", " ", 1).alias("_first")).agg(F.collect_set(size).alias("_lengths"))
    longest = phrases.agg(F.coalesce(F.max(size), F.lit(1))).scalar()
    rows = df.select(key, *carry, words_of(F.col(text)).alias("_w"), longest.alias("_longest"))
    windows = F.transform("_w", lambda w, i: F.struct(
        i.alias("pos"), w.alias("_first"), F.slice("_w", i + 1, F.col("_longest")).alias("_window")))
    runs = rows.select(key, *carry, F.inline(windows)).join(firsts, "_first").select(
        key, *carry, "pos", "_window", F.explode("_lengths").alias("n")).where(F.size("_window") >= F.col("n"))
    runs = runs.select(key, *carry, "pos", "n", F.array_join(F.slice("_window", F.lit(1), F.col("n")), " ").alias("phrase"))
    return runs.join(phrases, "phrase")


def place_phrases(cities: DataFrame, countries: DataFrame | None = None, garbage=is_garbage_city) -> DataFrame:
    """The dictionary of place names, written out: phrase, ``_cities`` (one of each country, lowest id first), ``_country``.

    ``cities``: city_id, name, country. ``countries``: country; those of the gazetteer count as well.
    """
    named = cities.select("city_id", "name", "country", phrase_of(F.col("name")).alias("phrase"), phrase_of(F.col("country")).alias("_c"))
    towns = (named.where((F.col("phrase") != "") & ~garbage(F.col("phrase"))).groupBy("phrase", "_c")
             .agg(F.min(F.struct("city_id", "name", "country")).alias("_r"))
             .groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("_r.city_id", "_c", "_r.name", "_r.country"))).alias("_cities")))
    states = cities.select("country")
    if countries is not None:
        states = states.unionByName(countries.select("country"))
    states = states.select(phrase_of(F.col("country")).alias("phrase"), "country").where("phrase <> ''").groupBy("phrase").agg(
        F.min("country").alias("_country"))
    return materialise(towns.join(states, "phrase", "full"), "phrases")


def text_mention(df: DataFrame, key: str, text: str, cities: DataFrame, *, countries: DataFrame | None = None,
                 stated: str | None = None, garbage=is_garbage_city) -> DataFrame:
    """The first gazetteer city and the first country named in the text, the longest when several start at one place.

    Of a name of several countries the city of a country that the text names is taken, then that of the country in column
    ``stated``, then the lowest id. Names are compared word by word. One row for each text (``key`` is unique) that names a
    place: key, mention, mention_country, country_mention. Null and empty texts name none.
    """
    said = phrase_of(F.col(stated)) if stated else F.lit(None).cast("string")
    hits = dictionary_scan(df.withColumn("_stated", said), key, text, place_phrases(cities, countries, garbage), ["_stated"])
    place = F.struct("pos", -F.col("n"))
    found = hits.groupBy(key).agg(
        F.first("_stated").alias("_stated"), F.collect_set(F.when(F.col("_country").isNotNull(), F.col("phrase"))).alias("_named"),
        F.min_by("_cities", F.when(F.col("_cities").isNotNull(), place)).alias("_cities"),
        F.min_by("_country", F.when(F.col("_country").isNotNull(), place)).alias("country_mention"))
    best = F.array_min(F.transform("_cities", lambda x: F.struct(
        F.coalesce(~F.array_contains("_named", x["_c"]), F.lit(True)).alias("a"), F.coalesce(x["_c"] != F.col("_stated"), F.lit(True)).alias("b"),
        x["city_id"].alias("city_id"), x["name"].alias("name"), x["country"].alias("country"))))
    return found.withColumn("_m", best).select(
        key, F.col("_m.name").alias("mention"), F.col("_m.country").alias("mention_country"), "country_mention")


def constrained_pick(df: DataFrame, key: str, text: str, country: str, cities: DataFrame, *,
                     share: float = vocab.PICK_MIN_SHARE, garbage=is_garbage_city) -> DataFrame:
    """The city of a known country whose name the text holds in scattered words: key, pick, pick_share.

    Ranked by the share of the name's words that are in the text (at least ``share``), then more words, then the name.
    Words that few names of the country have decide which names are looked at: a name reaches the share only if one of
    its size - ceil(share * size) + 1 rarest words is in the text.
    """
    named = (cities.where(~garbage(phrase_of(F.col("name")))).select(
        "name", F.lower("country").alias("_c"), F.array_distinct(words_of(F.col("name"))).alias("_names")).where(F.size("_names") > 0)
        .distinct())
    spelled = materialise(named.select("name", "_c", F.size("_names").alias("_n"), F.explode("_names").alias("_word")), "names")
    counts = spelled.groupBy("_c", "_word").agg(F.count("*").alias("_same"))
    ordered = spelled.join(counts, ["_c", "_word"]).groupBy("_c", "name", "_n").agg(
        F.array_sort(F.collect_list(F.struct("_same", "_word"))).alias("_o"))
    prefix = (F.col("_n") - F.ceil(F.col("_n") * F.lit(share) - 1e-9) + 1).cast("int")
    rare = ordered.select("_c", "name", F.explode(F.slice("_o", F.lit(1), prefix)).alias("_p")).select(
        "_c", "name", F.col("_p._word").alias("_word"))
    rows = df.select(key, F.lower(F.col(country)).alias("_c"), F.explode(F.array_distinct(words_of(F.col(text)))).alias("_word"))
    names = rows.join(rare, ["_c", "_word"]).select(key, "_c", "name").distinct()
    shared = names.join(spelled, ["_c", "name"]).join(rows, [key, "_c", "_word"], "left_semi").groupBy(key, "name", "_n").agg(
        (F.count("*") / F.col("_n")).alias("_share")).where(F.col("_share") >= share - 1e-9)
    best = shared.groupBy(key).agg(F.min(F.struct(-F.col("_share"), -F.col("_n"), F.col("name").alias("name"))).alias("_b"))
    return best.select(key, F.col("_b.name").alias("pick"), (-F.col("_b.col1")).alias("pick_share"))


def mapped(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    from bazaarflow.functions.rules import lit_map

    return F.try_element_at(lit_map(pairs), F.lower(F.trim(c)))


def country_of_city(df: DataFrame, city: str, cities: DataFrame, out: str = "country_of_city",
                    static=vocab.CITY_COUNTRIES) -> DataFrame:
    """Country of a city name: the short fixed list first, then the gazetteer."""
    found = lookup(df, F.col(city), cities, F.col("name"), [("country", "_dim")], "city_id")
    return found.withColumn(out, F.coalesce(mapped(F.col(city), static), F.col("_dim"))).drop("_dim")


def country_of_iso(code: Column, pairs=vocab.ISO_COUNTRIES) -> Column:
    return mapped(code, pairs)


def english_country(raw: Column, pairs=vocab.COUNTRY_EXONYMS) -> Column:
    return F.coalesce(mapped(raw, pairs), F.initcap(F.lower(raw)), F.lit(""))


def english_city(raw: Column, pairs=vocab.CITY_EXONYMS) -> Column:
    return F.coalesce(mapped(raw, pairs), F.trim(raw), F.lit(""))


def looks_foreign(c: Column, letters=vocab.FOREIGN_LETTERS) -> Column:
    return F.coalesce(F.lower(c).rlike(f"[{letters}]"), F.lit(False))


def split_country_city(address: Column) -> Column:
    """``Country - City`` → struct(city, country); a single part is the country."""
    parts = F.split(F.trim(F.coalesce(address, F.lit(""))), r"\s*[-–]\s*", 2)
    two = F.size(parts) == 2
    return F.struct(F.when(two, F.trim(F.get(parts, F.lit(1)))).otherwise(F.lit("")).alias("city"),
                    F.trim(F.get(parts, F.lit(0))).alias("country"))


def fill_from_address(city: Column, country: Column, address: Column) -> Column:
    """Missing city or country from ``Country - City`` or ``City, Country``; struct(city, country)."""
    address = F.trim(F.coalesce(address, F.lit("")))
    dashed, comma = F.contains(address, F.lit(" - ")), F.contains(address, F.lit(","))
    by_dash, by_comma = F.split(address, " - ", 2), F.split(address, ",", 2)
    city_part = F.when(dashed, F.trim(F.get(by_dash, F.lit(1)))).when(comma, F.trim(F.get(by_comma, F.lit(0))))
    country_part = F.when(dashed, F.trim(F.get(by_dash, F.lit(0)))).when(comma, F.trim(F.get(by_comma, F.lit(1))))
    return F.struct(F.coalesce(blank_to_null(city), city_part, F.lit("")).alias("city"),
                    F.coalesce(blank_to_null(country), country_part, F.lit("")).alias("country"))


def place_confidence(has_locality: Column, lat: Column, lng: Column, city_from_address: Column) -> Column:
    """.9 with coordinates, .5 with a locality, .3 with an address only, else 0."""
    return (F.when(has_locality & lat.isNotNull() & lng.isNotNull(), 0.9).when(has_locality, 0.5)
            .when(F.coalesce(city_from_address, F.lit("")) != "", 0.3).otherwise(0.0))


def numeric_or_null(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def zone_of(df: DataFrame, country: str, zones: DataFrame, default: int = 5, out: str = "zone_id") -> DataFrame:
    """Zone of a country name. ``zones``: country, zone_id."""
    found = lookup(df, F.col(country), zones, F.col("country"), [("zone_id", "_z")], "zone_id")
    return found.withColumn(out, F.coalesce("_z", F.lit(default))).drop("_z")


def wrong_us(country: Column, title: Column, words=vocab.US_CONTRADICTIONS) -> Column:
    return (F.lower(country) == "united states") & has_any(F.lower(title), words)


def resolve_places(df: DataFrame, key: str, cities: DataFrame, countries: DataFrame, *, title: str = "title",
                   description: str = "description", city_raw: str = "city_raw", country_raw: str = "country_raw",
                   mention_confidence: float = 1.0) -> DataFrame:
    """Adds city, country, lat, lng, location_confidence, location_sources.

    In order: drop garbage cities; a city named in the text, else a country named there; the stated city by trigrams inside
    that or the stated country; the stated country unless the text contradicts it; with a country alone, the city of it
    whose words the text holds; coordinates from the gazetteer.
    ``cities``: city_id, name, country, lat, lng. ``countries``: country_id, country.
    """
    base = df.withColumn("_city_raw", F.when(~is_garbage_city(F.col(city_raw)), F.trim(F.col(city_raw)))) \
        .withColumn("_country_raw", blank_to_null(F.col(country_raw))) \
        .withColumn("_text", F.concat_ws(" ", title, description))
    mention = text_mention(base, key, "_text", cities, countries=countries, stated="_country_raw")
    # Short rows, read twice below: texts are scanned once.
    mention = materialise(mention.select(key, F.col("mention").alias("_m"), F.col("mention_country").alias("_mc"), F.when(
        F.col("mention").isNull(), F.col("country_mention")).alias("_said")), "mentions")
    base = base.join(mention, key, "left")
    base = base.withColumn("_phrase", F.when(F.col("_m").isNull(), F.col("_city_raw"))) \
        .withColumn("_within", F.lower(F.coalesce("_said", "_country_raw")))
    # The trigram step works on the distinct stated places, from these two columns alone.
    fuzzy = best_city(base.where(F.col("_phrase").isNotNull()).select(
        F.col("_phrase").alias("phrase"), F.col("_within").alias("country")), cities)
    fuzzy = materialise(fuzzy, "cities").select(F.col("phrase").alias("_p"), F.col("country").alias("_pc"), F.col("city").alias("_f"),
                         F.col("city_country").alias("_fc"))
    base = base.join(fuzzy, (F.col("_phrase") == F.col("_p")) & F.col("_within").eqNullSafe(F.col("_pc")), "left")

    base = lookup(base, F.when(F.length(F.trim("_country_raw")) >= 2, F.col("_country_raw")), countries, F.col("country"),
                  [("country", "_known")], "country_id")
    from_text = F.col("_m").isNotNull()
    said = F.col("_said").isNotNull()
    from_raw = F.col("_f").isNotNull()
    use_raw_country = ~from_text & ~said & ~from_raw & F.col("_known").isNotNull() & ~F.coalesce(
        wrong_us(F.col("_country_raw"), F.col(title)), F.lit(False))
    base = (base.withColumn("city", F.coalesce("_m", "_f"))
            .withColumn("country", F.coalesce("_mc", "_said", "_fc", F.when(use_raw_country, F.col("_known"))))
            .withColumn("_raw_country", use_raw_country))
    picks = constrained_pick(base.where("city is null and country is not null"), key, "_text", "country", cities)
    base = base.join(picks, key, "left").withColumn("city", F.coalesce("city", "pick"))

    places = first_by(cities.withColumn("_n", F.lower("name")).withColumn("_c", F.lower("country")), ["_n", "_c"], "city_id",
                      ["lat", "lng"])
    base = base.join(places, (F.lower("city") == F.col("_n")) & (F.lower("country") == F.col("_c")), "left")
    overridden = from_text & F.coalesce(F.lower("_country_raw") != F.lower("_mc"), F.lit(False))
    confidence = F.greatest(
        F.when(from_text, F.lit(0.9 * mention_confidence)).otherwise(0.0), F.when(said, F.lit(0.6 * mention_confidence)).otherwise(0.0),
        F.when(from_raw, 0.75).otherwise(0.0), F.when(F.col("_raw_country"), 0.35).otherwise(0.0),
        F.coalesce(F.col("pick_share") * 0.65, F.lit(0.0)))
    sources = F.array_compact(F.array(
        F.when(from_text, F.lit("text_mention")), F.when(overridden, F.lit("country_overridden")),
        F.when(said, F.lit("text_country")),
        F.when(from_raw, F.lit("city_trigram")), F.when(F.col("_raw_country"), F.lit("country_stated")),
        F.when(F.col("pick").isNotNull(), F.lit("country_pick"))))
    return (base.withColumn("location_confidence", F.round(F.least(confidence, F.lit(1.0)), 2))
            .withColumn("location_sources", sources)
            .drop("_city_raw", "_country_raw", "_text", "_m", "_mc", "_said", "_phrase", "_within", "_p", "_pc", "_f", "_fc",
                  "_known", "_raw_country", "pick", "pick_share", "_n", "_c"))
