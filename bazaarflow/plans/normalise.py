"""The combined jobs: normalise raw products, correct labels, flatten the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarflow import vocab
from bazaarflow.functions import money, rules, text
from bazaarflow.operators.geo import resolve_places


def activity_of(title: Column, description: Column, category: Column, rule_set=vocab.STAGE_ACTIVITY_RULES) -> Column:
    blank = F.lit("")
    body = F.lower(F.concat_ws(" ", F.coalesce(title, blank), F.coalesce(description, blank), F.coalesce(category, blank)))
    return rules.first_label(body, rule_set, "EXCURSION")


def vocabulary_activity(*parts: Column, rule_set=vocab.ACTIVITY_RULES, match: str = "substring") -> Column:
    """Activity by the wide vocabulary; hyphens, underscores and slashes count as blanks."""
    body = F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))
    return rules.first_label(text.squeeze(F.regexp_replace(body, "[-_/]", " ")), rule_set, "EXCURSION", match)


def supplier_activity(categories: Column, name: Column) -> Column:
    """Activity of a supplier from its category list, else from its name."""
    joined = F.when(F.coalesce(F.size(categories), F.lit(0)) > 0, F.array_join(categories, " ")).otherwise(name)
    return vocabulary_activity(joined)


def category_of(activity: Column, title: Column, description: Column, rule_set=vocab.STAGE_CATEGORY_RULES) -> Column:
    body = F.lower(F.concat_ws(" ", title, description))
    return F.when(activity == "TRANSFER", F.lit("TRANSPORT")).otherwise(rules.first_label(body, rule_set, "CULTUREL"))


def route_of(body: Column, activity: Column | None = None) -> Column:
    """struct(origin, destination, signature) from "from A to B"; only for transfers when an activity is given."""
    pattern = r"from\s+([a-z\s]+?)\s+to\s+([a-z\s]+?)(?:\s|$)"
    low = F.lower(body)
    hit = low.rlike(pattern)
    if activity is not None:
        hit = hit & (activity == "TRANSFER")
    a = F.when(hit, F.initcap(F.trim(F.regexp_extract(low, pattern, 1))))
    b = F.when(hit, F.initcap(F.trim(F.regexp_extract(low, pattern, 2))))
    return F.struct(a.alias("origin"), b.alias("destination"), F.concat(a, F.lit(" → "), b).alias("signature"))


def service_route(body: Column, patterns=vocab.ROUTE_PATTERNS, airports=vocab.AIRPORT_WORDS) -> Column:
    """struct(origin, destination): ordered patterns, else the airport word alone.

    A pattern is only tried on texts that hold the words it needs: where it fails it takes the square of the text's length.
    """
    def found(low: Column) -> Column:
        out = None
        for p in patterns:
            hit = low.rlike("(?U)" + p)
            for words in reversed(rules.required_choices(p)):
                hit = rules.any_of(F.contains(low, F.lit(w)) for w in words) & hit
            value = F.struct(F.initcap(F.trim(F.regexp_extract(low, "(?U)" + p, 1))).alias("origin"),
                             F.initcap(F.trim(F.regexp_extract(low, "(?U)" + p, 2))).alias("destination"))
            out = F.when(hit, value) if out is None else out.when(hit, value)
        for w in airports:
            out = out.when(F.contains(low, F.lit(w)), F.struct(F.lit(w.upper()).alias("origin"), F.lit("").alias("destination")))
        return out.otherwise(F.struct(F.lit("").alias("origin"), F.lit("").alias("destination")))

    return rules.once(F.lower(body), found)


def correct_labels(df: DataFrame, *, activity: str = "activity", category: str = "category", city: str = "city",
                   country: str = "country", price: str = "price", body: str = "body", forbidden=vocab.CATEGORY_FORBIDDEN,
                   positive=vocab.CATEGORY_CORRECTIONS, hints=vocab.CITY_COUNTRY_HINTS) -> DataFrame:
    """Forced types, forbidden and positive categories, country by city hint, price bounds.

    Overwrites the columns and adds ``corrections``, the names of what changed, and ``was_corrected``.
    """
    low = F.col("_low")
    df = df.withColumn("_low", F.lower(body))
    forced = rules.first_label(low, [(vocab.FORCE_TRANSFER, "TRANSFER"), (vocab.FORCE_TICKET, "TICKET")])
    out = df.withColumn("_a", F.coalesce(forced, F.col(activity)))
    words = dict(positive)
    by_activity = F.when(F.col("_a") == "TRANSFER", "TRANSPORT").otherwise("CULTUREL")
    banned = None
    for label, kws in forbidden:
        fix = rules.first_label(low, [([k], F.lit(words[k]) if k in words else by_activity) for k in kws])
        banned = F.when(F.col(category) == label, fix) if banned is None else banned.when(F.col(category) == label, fix)
    out = out.withColumn("_c", F.coalesce(banned, F.col(category)))
    out = out.withColumn("_c", F.when(F.col("_a") == "TRANSFER", "TRANSPORT").otherwise(F.col("_c")))
    better = rules.first_label(low, [([k], v) for k, v in positive if v != "CULTUREL"])
    out = out.withColumn("_c", F.when(F.col("_c") == "CULTUREL", F.coalesce(better, F.col("_c"))).otherwise(F.col("_c")))
    hint = None
    for name, expected in hints:
        cond = F.contains(low, F.lit(name)) | F.coalesce(F.lower(F.col(city)) == name, F.lit(False))
        cond = cond & (F.lower(F.coalesce(country, F.lit(""))) != expected)
        hint = F.when(cond, F.lit(expected.title())) if hint is None else hint.when(cond, F.lit(expected.title()))
    out = (out.withColumn("_n", F.coalesce(hint, F.col(country)))
           .withColumn("_p", money.clamp_price(F.col(price), F.col("_a"))))
    changed = [("activity", activity, "_a"), ("category", category, "_c"), ("country", country, "_n"), ("price", price, "_p")]
    notes = F.array_compact(F.array(*[F.when(~F.col(old).eqNullSafe(F.col(new)), F.lit(name)) for name, old, new in changed]))
    out = out.withColumn("corrections", notes).withColumn("was_corrected", F.size("corrections") > 0)
    return (out.withColumn(activity, F.col("_a")).withColumn(category, F.col("_c")).withColumn(country, F.col("_n"))
            .withColumn(price, F.col("_p")).drop("_a", "_c", "_n", "_p", "_low"))


def stage_confidence(title, description, price, estimated, city, country, place_confidence) -> Column:
    given = text.present
    base = rules.weighted_presence([
        (given(title), 0.20), (given(description), 0.10), (price.isNotNull() & ~estimated, 0.20), (given(city), 0.20),
        (given(country), 0.10), (F.lit(True), 0.10)])
    return F.round(F.least(base + place_confidence * 0.10, F.lit(1.0)), 2)


def service_confidence(title, description, city, country, service, price, supplier, duration=None) -> Column:
    given = text.present
    parts = [(given(title), 0.20), (given(description), 0.10), (given(city), 0.20), (given(country), 0.15),
             (given(service), 0.10), (price > 0, 0.10), (given(supplier), 0.10)]
    if duration is not None:
        parts.append((duration > 0, 0.05))
    return rules.weighted_presence(parts)


def clean_confidence(title, description, price_text, cities) -> Column:
    return rules.weighted_presence([
        (F.length(title) >= vocab.MIN_CLEAN_TITLE, 0.35), (F.length(description) >= vocab.MIN_CLEAN_DESCRIPTION, 0.35),
        (price_text != "", 0.15), (F.size(cities) > 0, 0.15)])


def normalise(raw: DataFrame, cities: DataFrame, countries: DataFrame, *, title_cap: int | None = None,
              description_cap: int | None = None) -> DataFrame:
    """Raw products to normalised products; rows with a title under five characters are dropped.

    ``raw``: product_id, supplier_id, run_id, title, title_en, description, description_en, price, currency,
    duration, category_raw, city_raw, country_raw.
    """
    def pick(a, b):
        return F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))

    rows = (raw.withColumn("title", text.light_clean(pick("title_en", "title"), title_cap))
            .withColumn("description", text.light_clean(pick("description_en", "description"), description_cap))
            .where(F.length("title") >= 5)
            .withColumn("activity", activity_of(F.col("title"), F.col("description"), F.col("category_raw"))))
    rows = resolve_places(rows, "product_id", cities, countries)
    body = F.concat_ws(" ", "title", "description")
    rows = money.process_price(rows, "price", "currency", body)
    rows = (rows.withColumn("_route", route_of(body, F.col("activity")))
            .withColumn("category", category_of(F.col("activity"), F.col("title"), F.col("description")))
            .withColumn("duration_minutes", money.minutes_first(F.col("duration")))
            .withColumn("matching_signature", text.signature(F.col("city"), F.col("activity"), F.col("title")))
            .withColumn("activity_tags", rules.flags(F.lower(body), vocab.STAGE_FLAG_WORDS)))
    rows = rows.withColumn("embedding_text", text.embedding_text(
        F.col("title"), F.col("description"), F.col("city"), F.col("country"), F.col("activity"), F.col("category")))
    return rows.select(
        "product_id", "supplier_id", "run_id", "title", "description", "city", "country", "lat", "lng", "location_confidence",
        "location_sources", "activity", "category", F.col("eur").alias("price"), F.lit("EUR").alias("currency"),
        F.col("estimated").alias("price_is_estimated"), "duration_minutes", F.col("_route.origin").alias("origin"),
        F.col("_route.destination").alias("destination"), F.col("_route.signature").alias("route_signature"),
        "matching_signature", "activity_tags", "embedding_text",
        stage_confidence(F.col("title"), F.col("description"), F.col("eur"), F.col("estimated"), F.col("city"),
                         F.col("country"), F.col("location_confidence")).alias("confidence"))


def flatten_catalogue(products: DataFrame, localities: DataFrame, details: DataFrame, product_themes: DataFrame,
                      themes: DataFrame, preferred_languages=(2, 1)) -> DataFrame:
    """One row per catalogue product with locality, text in the preferred language and its themes.

    Children are brought to one row per product before the joins, so nothing fans out.
    """
    from bazaarflow.operators.reports import distinct_list, language_text

    text_rows = language_text(details, "product_id", "language_id", preferred_languages, "text", "detail_text")
    named = product_themes.join(themes, "theme_id").select("product_id", "theme")
    theme_rows = distinct_list(named, "product_id", "theme", "themes")
    return (products.join(localities, "locality_id", "left").join(text_rows, "product_id", "left")
            .join(theme_rows, "product_id", "left").withColumn("detail_text", F.coalesce("detail_text", F.lit(""))))


def gate_products(df: DataFrame, *, title: str = "title", city: str = "city_raw", country: str = "country_raw",
                  junk=vocab.JUNK_TITLES, patterns=vocab.JUNK_TITLE_PATTERNS, junk_cities=vocab.JUNK_CITIES,
                  min_length: int = 8, city_words: int = 4) -> DataFrame:
    """Adds ``reject_reason`` (null = accepted) and clears junk or overlong cities and empty countries."""
    name = F.trim(F.coalesce(F.col(title), F.lit("")))
    low = F.lower(name)
    reason = (F.when(name == "", "missing").when(F.length(name) < min_length, "short").when(rules.one_of(low, junk), "junk_title")
              .when(rules.matches_any(low, patterns), "junk_pattern").when(text.word_count(name) < 2, "single_word"))
    stated = F.trim(F.coalesce(F.col(city), F.lit("")))
    bad_city = rules.one_of(F.lower(stated), junk_cities) | (text.word_count(stated) > city_words)
    return (df.withColumn("reject_reason", reason).withColumn(city, F.when(~bad_city, F.col(city)))
            .withColumn(country, F.nullif(F.col(country), F.lit(""))))


def canonical_catalogue(df: DataFrame) -> DataFrame:
    """Catalogue rows in the common schema (title, description, place, prices, operator, source)."""
    blank = F.lit("")
    return df.select(
        F.coalesce(F.nullif("name_en", blank), F.nullif("name", blank), F.nullif("first_name", blank), blank).alias("title"),
        F.coalesce("description", blank).alias("description"), F.coalesce("city", blank).alias("city"),
        F.coalesce("country", blank).alias("country"), F.col("min_price").cast("double").alias("price_min"),
        F.col("max_price").cast("double").alias("price_max"), F.coalesce("currency", F.lit("EUR")).alias("currency"),
        F.coalesce("operator", blank).alias("operator"), F.lit("CATALOG").alias("source"),
        F.col("product_id").alias("source_id"), "url")


def canonical_scraped(df: DataFrame) -> DataFrame:
    """Supplier rows in the common schema."""
    blank = F.lit("")
    return df.select(
        F.coalesce(F.nullif("raw_title", blank), F.nullif("clean_title", blank), blank).alias("title"),
        F.coalesce("description", blank).alias("description"), F.coalesce("city", blank).alias("city"),
        F.coalesce("country", blank).alias("country"), F.coalesce("price", "estimated_price").cast("double").alias("price_min"),
        F.coalesce("price_max", "estimated_price").cast("double").alias("price_max"),
        F.coalesce(F.nullif("currency", blank), F.lit("EUR")).alias("currency"), F.coalesce("operator", blank).alias("operator"),
        F.lit("SCRAPED").alias("source"), F.col("product_id").alias("source_id"), "url")


def canonical(df: DataFrame) -> DataFrame:
    """Mixed rows in the common schema: a row with an English name or catalogue id is a catalogue row."""
    is_catalogue = F.col("name_en").isNotNull() | F.col("catalog_id").isNotNull()
    return canonical_catalogue(df.where(is_catalogue)).unionByName(canonical_scraped(df.where(~is_catalogue)))
