"""Catalogue stages: the rebuild over role-playing dimensions, the stage on flattened rows, and the service stage.

All three are one lazy plan each. Children (texts by language, themes, languages) come down to one row per product before
they meet the products, and a dimension that plays several roles is read once per role by its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarflow import vocab
from bazaarflow.functions import money, rules, text
from bazaarflow.operators import geo
from bazaarflow.operators.lookup import first_by
from bazaarflow.operators.reports import distinct_array, distinct_list, language_text
from bazaarflow.plans.normalise import service_confidence, service_route


def _trimmed(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def localities_in_role(localities: DataFrame, role: str) -> DataFrame:
    """The locality dimension with its columns named for a role: one row per key, the first by content."""
    values = [c for c in localities.columns if c != "locality_id"]
    one = first_by(localities, ["locality_id"], F.struct(*values), values)
    return one.select(F.col("locality_id").alias(f"_{role}_id"), *[F.col(c).alias(f"_{role}_{c}") for c in values])


def rebuild(products: DataFrame, localities: DataFrame, details: DataFrame, product_themes: DataFrame, product_languages: DataFrame,
            *, language: int = 44) -> DataFrame:
    """One normalised row per catalogue product.

    ``products``: product_id, name, name_en, description, type_code, price, currency_code, active, sellable, city_id, departure_id,
    arrival_id, supplier_id, operator, hours, minutes, promo, private, b2c, address, product_type, category, external_id.
    ``localities``: locality_id, name, name_en, lat, lng. ``details``: product_id, language_id, text. ``product_themes``:
    product_id, theme_id. ``product_languages``: product_id, language.

    The text in ``language`` stands in for a missing description (of several the greatest); the city's locality gives place and coordinates,
    departure and arrival the route of a transfer, the address whatever the locality lacks. Keys without a locality find none.
    """
    said = text.drop_tags(F.coalesce("_detail", F.lit("")))
    own = details.where(F.col("language_id") == language).groupBy(F.col("product_id").alias("_d")).agg(F.max("text").alias("_detail"))
    theme_rows = distinct_array(product_themes, "product_id", "theme_id", "_themes").withColumnRenamed("product_id", "_t")
    spoken = distinct_array(product_languages.where(F.col("language") != ""), "product_id", "language", "_languages").withColumnRenamed("product_id", "_l")
    rows = products.join(own, F.col("product_id") == F.col("_d"), "left").join(theme_rows, F.col("product_id") == F.col("_t"), "left") \
        .join(spoken, F.col("product_id") == F.col("_l"), "left")
    for role, key in (("city", "city_id"), ("from", "departure_id"), ("to", "arrival_id")):
        rows = rows.join(localities_in_role(localities, role), F.col(key) == F.col(f"_{role}_id"), "left")

    activity = money.code_label(F.col("type_code"), vocab.ACTIVITY_CODES, "EXCURSION")
    own_text = text.drop_tags(F.coalesce("description", F.lit("")))
    rows = rows.withColumn("title", _trimmed(F.col("name"))).withColumn("title_en", _trimmed(F.col("name_en"))) \
        .withColumn("activity", activity).withColumn("_description", F.when(own_text == "", said).otherwise(own_text)) \
        .withColumn("_address", geo.split_country_city(F.col("address")))
    stop = lambda role: F.coalesce(_given(_trimmed(F.col(f"_{role}_name_en"))), _trimmed(F.col(f"_{role}_name")))
    is_transfer = F.col("activity") == "TRANSFER"
    rows = rows.withColumn("origin", F.when(is_transfer, stop("from")).otherwise("")).withColumn("destination", F.when(is_transfer, stop("to")).otherwise("")) \
        .withColumn("_city", F.coalesce(_given(stop("city")), F.col("_address.city"))) \
        .withColumn("city", geo.english_city(F.col("_city"))).withColumn("country", geo.english_country(_given(F.col("_address.country"))))
    has_city = F.col("city_id").isNotNull() & (F.col("city_id") != 0)
    located = F.coalesce((F.col("_city_lat") != 0) & (F.col("_city_lng") != 0), F.lit(False))
    confidence = F.when(has_city & F.col("_city_id").isNotNull(), F.when(located, 0.9).otherwise(0.5)).when(~has_city & (F.col("_address.city") != ""), 0.3).otherwise(0.0)
    flag = lambda name: F.coalesce(F.col(name).cast("boolean"), F.lit(False))
    signature = text.signature(F.col("city"), F.col("activity"), F.coalesce(_given(F.col("title_en")), F.col("title")), vocab.CATALOG_SIGNATURE_STOP)
    empty = F.array()
    return rows.select(
        "product_id", _given(F.col("title")).alias("title"), _given(F.col("title_en")).alias("title_en"), _given(F.col("_description")).alias("description"),
        _given(F.col("city")).alias("city"), _given(F.col("country")).alias("country"), F.when(has_city, F.col("_city_lat")).alias("lat"),
        F.when(has_city, F.col("_city_lng")).alias("lng"), confidence.alias("city_confidence"), "activity",
        money.code_label(F.col("activity"), vocab.SERVICE_CODES, "TOUR").alias("service"), _given(_trimmed(F.col("category"))).alias("category"),
        _given(_trimmed(F.col("product_type"))).alias("product_type"), _given(F.col("origin")).alias("origin"),
        _given(F.col("destination")).alias("destination"),
        F.when((F.col("origin") != "") | (F.col("destination") != ""), F.concat("origin", F.lit(" → "), F.col("destination"))).alias("route_signature"),
        F.nullif(F.col("price").cast("double"), F.lit(0.0)).alias("price"), money.code_label(F.col("currency_code"), vocab.CURRENCY_CODES, "EUR").alias("currency"),
        flag("promo").alias("is_promo"), money.minutes_of(F.col("hours"), F.col("minutes")).alias("duration_minutes"),
        flag("active").alias("is_active"), flag("sellable").alias("is_sellable"), _given(F.coalesce("operator", F.lit(""))).alias("supplier_name"),
        "supplier_id", F.nullif(F.col("external_id"), F.lit(0)).alias("external_id"),
        F.struct(flag("promo").alias("is_promo"), flag("private").alias("is_private"), flag("b2c").alias("is_b2c"),
                 F.coalesce("_themes", empty).alias("themes"), F.coalesce("_languages", empty).alias("languages")).alias("activity_tags"),
        signature.alias("matching_signature"),
        text.catalog_embedding_text(F.col("title"), F.col("title_en"), F.col("_description"), F.col("city"), F.col("country"), F.col("activity"),
                                    _trimmed(F.col("category"))).alias("embedding_text"),
        confidence.alias("confidence"))


def catalogue_rows(products: DataFrame, localities: DataFrame, details: DataFrame, product_themes: DataFrame, themes: DataFrame,
                   preferred=(2, 1)) -> DataFrame:
    """Products with place, title and text in the preferred language, and the names of their themes.

    ``localities``: locality_id, name, name_en, iso, lat, lng (coordinates as text). ``details``: product_id, language_id, title, text.
    """
    one = lambda column: language_text(details, "product_id", "language_id", preferred, column, f"detail_{column}")
    names = distinct_list(product_themes.join(themes, "theme_id"), "product_id", "theme", "themes")
    place = localities_in_role(localities, "city")
    rows = products.join(place, F.col("city_id") == F.col("_city_id"), "left")
    for child in (one("title"), one("text"), names):
        key = child.withColumnRenamed("product_id", "_k")
        rows = rows.join(key, F.col("product_id") == F.col("_k"), "left").drop("_k")
    number = lambda c: F.when(c.rlike(r"^-?[0-9]+\.?[0-9]*$"), c.try_cast("double"))
    return rows.withColumn("city_name", F.coalesce("_city_name_en", "_city_name", F.lit(""))).withColumn("country_iso", F.coalesce("_city_iso", F.lit(""))) \
        .withColumn("lat", number(F.col("_city_lat"))).withColumn("lng", number(F.col("_city_lng"))) \
        .drop(*[c for c in rows.columns if c.startswith("_city_")])


def catalogue_service(body: Column, code: Column) -> Column:
    """Service of a catalogue product: what its type code says, else the first rule whose word occurs."""
    low = F.lower(F.coalesce(code.cast("string"), F.lit("")))
    ticket = rules.has_any(low, vocab.CATALOG_TICKET_CODES)
    transfer = low.isin(*vocab.CATALOG_TRANSFER_CODES) | rules.has_any(low, vocab.CATALOG_TRANSFER_WORDS)
    return F.when(ticket, "TICKET").when(transfer, "TRANSFER").otherwise(rules.first_label(F.lower(body), vocab.CATALOG_SERVICE_RULES, "TOUR"))


def catalogue_stage(rows: DataFrame, cities: DataFrame) -> DataFrame:
    """Normalised catalogue products from ``catalogue_rows``, with title, description, type_code, address, operator, price, currency,
    categories and flags. A city without a country gets that of the fixed list or of ``cities`` (city_id, name, country)."""
    blank = F.lit("")
    named = text.drop_tags(F.coalesce(_given(F.col("detail_title")), _given(F.col("title")), _given(F.col("title_fr")), blank))
    rows = rows.withColumn("clean_title", F.when(F.coalesce(_given(F.col("detail_title")), _given(F.col("title")), _given(F.col("title_fr"))).isNull(),
                                                 F.concat(F.lit("Product #"), F.col("product_id").cast("string"))).otherwise(named)) \
        .withColumn("clean_description", text.drop_tags(F.coalesce(_given(F.col("detail_text")), F.col("description"), blank))) \
        .withColumn("_iso", F.lower(F.trim("country_iso"))).withColumn("_address", _trimmed(F.col("address")))
    stated = F.coalesce(geo.country_of_iso(F.col("_iso")), blank)
    rows = rows.withColumn("_place", geo.fill_from_address(F.trim("city_name"), stated, F.col("_address"))).withColumn("_c", F.col("_place.city"))
    rows = geo.country_of_city(rows, "_c", cities, "_found")
    country = F.when((F.col("_place.country") == "") & (F.col("_c") != ""), F.coalesce("_found", blank)).otherwise(F.col("_place.country"))
    rows = rows.withColumn("country", country)
    from_address = F.when(F.contains("_address", F.lit(",")), F.trim(F.get(F.split("_address", ","), F.lit(0)))).otherwise(F.col("_address"))
    rows = rows.withColumn("city", F.when((F.col("country") != "") & (F.col("_c") == "") & (F.col("_address") != ""), from_address).otherwise(F.col("_c")))
    rows = rows.withColumn("_body", F.concat_ws(" ", "clean_title", "clean_description", F.coalesce("themes", blank))).withColumn("_low", F.lower("_body"))
    low = F.col("_low")
    airport = rules.first_label(low, [([w], w.upper()) for w in vocab.CATALOG_AIRPORT_WORDS], "")
    family = rules.first_label(low, vocab.CATALOG_FAMILY_RULES, vocab.THEME_DEFAULT[0])
    flags = rules.flags(low, vocab.CATALOG_FLAG_WORDS)
    price = F.coalesce(F.col("price").cast("double"), F.lit(0.0))
    rows = rows.withColumn("service", catalogue_service(F.col("_body"), F.col("type_code"))).withColumn("origin", airport) \
        .withColumn("family", family).withColumn("_flags", flags).withColumn("_price", price) \
        .withColumn("tags", rules.tags(low, [(w, [w]) for w in vocab.CATALOG_TAG_WORDS]))
    shown = F.array_compact(F.array(*[F.when(F.col(f"_flags.is_{f}"), F.lit(f)) for f in vocab.SHOWN_FLAGS]))
    supplier = F.coalesce("operator", blank)
    return rows.select(
        "product_id", "clean_title", "clean_description", "city", "country", F.col("_iso").alias("country_iso"), F.col("_price").alias("price"),
        money.code_label(F.col("currency"), vocab.CURRENCY_CODES_WIDE, "EUR").alias("currency") if dict(rows.dtypes)["currency"] != "string"
        else F.coalesce(_given(F.col("currency")), F.lit("EUR")).alias("currency"),
        F.coalesce(_given(F.col("category")), _given(F.col("product_type")), _given(F.col("kind")), F.col("family")).alias("category"),
        F.coalesce("subcategory", blank).alias("subcategory"), F.coalesce("product_type", blank).alias("product_type"),
        F.coalesce("product_group", blank).alias("product_group"), "service", "family", "origin", blank.alias("destination"),
        F.replace("origin", F.lit(" "), F.lit("_")).alias("route_signature"), "_flags.*",
        (F.coalesce("active", F.lit(1)) == 1).alias("is_active"), (F.coalesce("sellable", F.lit(1)) == 1).alias("is_sellable"), "tags",
        supplier.alias("supplier_name"), "supplier_id", "lat", "lng",
        service_confidence(F.col("clean_title"), F.col("clean_description"), F.col("city"), F.col("country"), F.col("service"), F.col("_price"), supplier).alias("confidence"),
        text.service_embedding_text(F.col("service"), F.col("family"), F.col("origin"), blank, F.col("city"), F.col("country"), shown, None,
                                    F.col("clean_title"), F.col("clean_description")).alias("embedding_text"))


def service_type(body: Column, activity: Column | None = None, access: Column | None = None, transport: Column | None = None,
                 vocabulary=vocab.SERVICE_VOCABULARY) -> Column:
    """Service of a product. A supplier's own transfer or ticket goes first, then what the page's access and transport
    layers (arrays) name, then the vocabulary with the most hits for the length of the text."""
    scored = rules.scored_label(body, vocabulary, vocab.SERVICE_THRESHOLD, vocab.SERVICE_DEFAULT)
    out = None
    own = None if activity is None else F.upper(F.trim(activity))
    layered = [(None if own is None else own.isin(*vocab.OWN_SERVICES), own), *[
        (None if layer is None else F.arrays_overlap(layer, rules.lit_array(words)), F.lit(label))
        for layer, (label, words) in zip((access, transport), vocab.SERVICE_LAYERS, strict=True)]]
    for found, label in layered:
        if found is not None:
            cond = F.coalesce(found, F.lit(False))
            out = F.when(cond, label) if out is None else out.when(cond, label)
    return scored if out is None else out.otherwise(scored)


def service_stage(rows: DataFrame, cities: DataFrame) -> DataFrame:
    """Normalised products with service, theme, flags, tags, route, price and duration.

    ``rows``: product_id, title, description, city, country, price, currency, activity, access, transport, breadcrumb, duration, inclusions,
    page_description, url, source, platform. Rows with a title under five characters are dropped. A missing country comes from the
    city (fixed list, then ``cities``), a missing city from the first known city in the text, a missing price from rules.
    """
    blank = F.lit("")
    base = rows.where(F.length(F.trim("title")) >= 5) \
        .withColumn("_title", text.marketing_title(F.trim("title"))).withColumn("_text", text.without_marketing(_trimmed(F.col("description")))) \
        .withColumn("_city", _trimmed(F.col("city"))).withColumn("_country", _trimmed(F.col("country")))
    base = geo.country_of_city(base, "_city", cities, "_found")
    unknown = F.lower("_country").isin("", "unknown")
    low_text = F.lower(F.concat_ws(" ", "_title", "_text"))
    in_text = rules.first_label(low_text, [([c], c.title()) for c, _ in vocab.CITY_COUNTRIES], "")
    base = base.withColumn("out_country", F.when(unknown, F.coalesce(F.when(F.col("_city") != "", F.col("_found")), blank)).otherwise(F.col("_country"))) \
        .withColumn("out_city", F.when(F.col("_city") != "", F.col("_city")).otherwise(in_text)) \
        .withColumn("_low", F.lower(F.concat(F.col("_title"), F.lit(" "), F.col("_text"), F.lit(" "), F.coalesce("page_description", blank))))
    low = F.col("_low")
    context = F.lower(F.concat_ws(" ", "_low", F.coalesce("breadcrumb", blank), F.coalesce("duration", blank), F.coalesce("inclusions", blank)))
    theme = rules.first_label(context, [([k], F.struct(F.lit(f).alias("family"), F.lit(s).alias("subtype"))) for k, f, s in vocab.THEME_RULES],
                              F.struct(*[F.lit(v).alias(n) for n, v in zip(("family", "subtype"), vocab.THEME_DEFAULT, strict=True)]))
    ruled = money.rule_price(F.lower(F.concat_ws(" ", "title", F.coalesce("description", blank))), F.coalesce("activity", blank))
    base = base.withColumn("service", service_type(low, F.col("activity"), F.col("access"), F.col("transport"))).withColumn("_theme", theme) \
        .withColumn("_flags", rules.flags(low, vocab.FLAG_WORDS)).withColumn("tags", rules.tags(low, vocab.TAG_WORDS)) \
        .withColumn("_route", service_route(F.concat_ws(" ", F.lower("_title"), "_low"))) \
        .withColumn("_price", F.when(F.col("price").cast("double") > 0, F.col("price").cast("double")).otherwise(ruled)) \
        .withColumn("duration_minutes", money.minutes_sum(F.col("duration")))
    o, d = F.col("_route.origin"), F.col("_route.destination")
    by_service = lambda pairs, default: F.coalesce(F.try_element_at(rules.lit_map(pairs), F.col("service")), F.lit(default))
    shown = F.array_compact(F.array(*[F.when(F.col(f"_flags.is_{f}"), F.lit(f)) for f in vocab.SHOWN_FLAGS]))
    source = F.coalesce("source", blank)
    market = rules.first_label(F.lower(F.concat_ws(" ", F.coalesce("url", blank), source)), vocab.MARKETPLACE_SOURCES,
                               F.when(source != "", F.upper(source)).otherwise("DIRECT_SUPPLIER"))
    return base.select(
        "product_id", F.col("_title").alias("clean_title"), F.col("_text").alias("clean_description"), F.col("out_city").alias("city"),
        F.col("out_country").alias("country"), by_service(vocab.SERVICE_CATEGORIES, "Tours & Sightseeing").alias("category"),
        by_service(vocab.SERVICE_KINDS, "excursion").alias("kind"), "service", F.col("_theme.subtype").alias("subtype"), F.col("_theme.family").alias("family"),
        o.alias("origin"), d.alias("destination"),
        F.when((o != "") & (d != ""), F.concat(F.upper(o), F.lit("→"), F.upper(d))).otherwise("").alias("route_signature"), "_flags.*", "tags",
        F.col("_price").alias("price"), F.coalesce("currency", F.lit("EUR")).alias("currency"), "duration_minutes",
        F.coalesce("platform", blank).alias("supplier"), market.alias("marketplace"),
        service_confidence(F.col("_title"), F.col("_text"), F.col("out_city"), F.col("out_country"), F.col("service"), F.col("_price"), F.col("platform"),
                           F.col("duration_minutes")).alias("confidence"),
        text.service_embedding_text(F.col("service"), F.col("_theme.family"), o, d, F.col("out_city"), F.col("out_country"), shown, F.col("tags"),
                                    F.col("_title"), F.col("_text")).alias("embedding_text"))
