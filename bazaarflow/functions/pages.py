"""Features of web pages and of model replies, as native column expressions."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarflow import vocab
from bazaarflow.functions.money import price_near
from bazaarflow.functions.rules import any_of, first_label, first_pattern, has_any, hits, matches_any, one_of
from bazaarflow.functions.text import decode_entities, drop_tags, host, present, word_count

ACTIVITIES = ["EXCURSION", "TICKET", "TRANSFER"]


def is_product_url(url: Column, extensions=vocab.REJECT_EXTENSIONS, reject=vocab.REJECT_URL_PATTERNS,
                   require=vocab.PRODUCT_PATH_PATTERNS) -> Column:
    low = F.lower(url)
    asset = any_of(low.endswith(e) | F.contains(low, F.lit(e + "?")) for e in extensions)
    return ~F.coalesce(asset, F.lit(True)) & ~matches_any(low, reject) & matches_any(low, require)


def page_type(url: Column, types=vocab.PAGE_TYPES, product=vocab.PAGE_PRODUCT_PATTERNS) -> Column:
    return first_pattern(F.lower(url), [*types, *[(p, "PRODUCT") for p in product]], "UNKNOWN")


def is_product_page(url: Column, html: Column, other=vocab.PAGE_OTHER_PATTERNS, product=vocab.PAGE_PRODUCT_PATTERNS,
                    signals=vocab.PAGE_CONTENT_SIGNALS, least: int = 2) -> Column:
    """By URL; a URL that tells nothing is decided by content signals anywhere in the page."""
    low = F.lower(url)
    by_url = matches_any(low, product)
    by_content = hits(F.lower(F.coalesce(html, F.lit(""))), [s.lower() for s in signals]) >= least
    return present(F.coalesce(url, F.lit(""))) & ~matches_any(low, other) & (by_url | by_content)


def supplier_signals(html: Column, cities=(), points=vocab.SUPPLIER_POINTS, channels=vocab.CHANNEL_SIGNALS,
                     api=vocab.API_SIGNALS, products=vocab.PRODUCT_SIGNALS, cta=vocab.CTA_SIGNALS,
                     price=vocab.PRICE_SIGNALS) -> Column:
    """struct(channel, has_api, has_products, has_cta, has_price, score 0..100)."""
    low = F.lower(F.coalesce(html, F.lit("")))
    channel = first_label(low, [([s], name) for s, name in channels])
    found = {"api": has_any(low, api), "products": has_any(low, products), "cta": has_any(low, cta),
             "price": has_any(low, price)}
    score = F.when(channel.isNotNull(), points["channel"]).otherwise(0) + hits(low, list(cities)) * points["city"]
    score = functools.reduce(operator.add, [F.when(c, points[k]).otherwise(0) for k, c in found.items()], score)
    return F.struct(channel.alias("channel"), found["api"].alias("has_api"), found["products"].alias("has_products"),
                    found["cta"].alias("has_cta"), found["price"].alias("has_price"),
                    F.least(score, F.lit(100)).alias("score"))


def connection(text: Column, channels=vocab.CHANNEL_SIGNALS, api=vocab.API_SIGNALS) -> Column:
    """struct(has_api, api_name, has_channel, channel_name, type) from any text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    channel = first_label(low, [([s], name) for s, name in channels])
    has_api = has_any(low, api)
    return F.struct(has_api.alias("has_api"), F.when(has_api, F.lit("API_DIRECT")).alias("api_name"),
                    channel.isNotNull().alias("has_channel"), channel.alias("channel_name"),
                    connection_type(has_api, channel.isNotNull()).alias("type"))


def connection_type(has_api: Column, has_channel: Column) -> Column:
    return (F.when(has_api & has_channel, "BOTH").when(has_api, "API").when(has_channel, "CHANNEL").otherwise("NONE"))


def is_connected(has_api: Column, has_channel: Column) -> Column:
    return F.coalesce(has_api, F.lit(False)) | F.coalesce(has_channel, F.lit(False))


def is_travel_supplier(*texts: Column, words=vocab.TRAVEL_WORDS) -> Column:
    return has_any(F.lower(F.concat_ws(" ", *texts)), words)


def embedded_geo(html: Column, address: Column | None = None) -> Column:
    """struct(country, city) from embedded JSON; the city falls back to the start of the address."""
    def first(pattern, minimum):
        v = F.trim(F.regexp_extract(html, "(?i)" + pattern, 1))
        return F.when(F.length(v) > minimum, v)

    country = F.coalesce(first(r'"addressCountry"\s*:\s*"([^"]{2,50})"', 2), first(r'"country"\s*:\s*"([^"]{2,50})"', 2))
    city = F.coalesce(first(r'"addressLocality"\s*:\s*"([^"]+)"', 0), first(r'"locality"\s*:\s*"([^"]+)"', 0))
    if address is not None:
        city = F.coalesce(city, F.nullif(F.trim(F.get(F.split(address, ","), F.lit(0))), F.lit("")))
    return F.struct(country.alias("country"), city.alias("city"))


LD_SCHEMA = ("array<struct<`@type`:string,name:string,description:string,offers:string,location:string,"
             "address:string,url:string,provider:string,organizer:string>>")
OFFER_SCHEMA = "array<struct<price:string,priceCurrency:string>>"
PLACE_SCHEMA = "struct<addressLocality:string,addressCountry:string>"


def ld_items(html: Column) -> Column:
    """All items of the JSON-LD blocks of a page; a block is an object or a list, a broken one counts as none."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type\s*=\s*["\']application/ld\+json["\'][^>]*>(.*?)</script>'), F.lit(1))
    return F.flatten(F.transform(blocks, lambda b: F.coalesce(F.from_json(b, LD_SCHEMA), F.from_json(F.lit("[]"), LD_SCHEMA))))


def ld_products(html: Column, page_url: Column, types=vocab.LD_PRODUCT_TYPES, cap: int | None = None,
                activity_rules=vocab.HEURISTIC_ACTIVITY_RULES) -> Column:
    """Product items of the JSON-LD blocks: title, description, price_raw, category, activity, city, country, url."""
    items = F.filter(ld_items(html), lambda i: has_any(i["@type"], types) & present(F.coalesce(i["name"], F.lit(""))))

    def product(i):
        offer = F.get(F.from_json(i["offers"], OFFER_SCHEMA), F.lit(0))
        single = F.coalesce(F.startswith(F.trim(i["offers"]), F.lit("{")), F.lit(False))
        price = F.concat_ws(" ", F.nullif(offer["price"], F.lit("")), F.when(single, offer["priceCurrency"]))
        place = F.from_json(F.coalesce(F.nullif(i["location"], F.lit("{}")), i["address"]), PLACE_SCHEMA)
        return F.struct(i["name"].alias("title"), F.coalesce(i["description"], F.lit("")).alias("description"),
                        price.alias("price_raw"), i["@type"].alias("category"),
                        first_label(F.lower(i["name"]), activity_rules, "EXCURSION").alias("activity"),
                        F.coalesce(place["addressLocality"], F.lit("")).alias("city"),
                        F.coalesce(place["addressCountry"], F.lit("")).alias("country"),
                        F.coalesce(i["url"], page_url).alias("url"))

    out = F.transform(items, product)
    return out if cap is None else F.slice(out, 1, cap)


def heading_products(html: Column, words=vocab.HEADING_WORDS, cap: int | None = None,
                     elements=("script", "style", "nav", "footer", "header", "aside", "form", "iframe")) -> Column:
    """Headings that read like products, distinct in order, with the first price up to the next heading."""
    body = F.regexp_replace(html, r"(?is)<(" + "|".join(elements) + r")\b[^>]*>.*?</\1>", " ")
    pieces = F.filter(F.split(body, r"(?i)(?=<h[1-4][\s>])"), lambda p: p.rlike(r"(?i)^<h[1-4][\s>]"))
    found = F.transform(pieces, lambda p: F.struct(
        decode_entities(drop_tags(F.regexp_extract(p, r"(?is)^<h[1-4][^>]*>(.*?)</h[1-4]>", 1))).alias("title"),
        decode_entities(F.coalesce(F.trim(price_near(p)), F.lit(""))).alias("price_raw")))
    good = F.filter(found, lambda x: (F.length(x["title"]) > 10) & (F.length(x["title"]) < 150)
                    & (has_any(F.lower(x["title"]), words) if words else F.lit(True)))
    titles = F.transform(good, lambda x: x["title"])
    out = F.filter(good, lambda x, i: F.array_position(titles, x["title"]) == i + 1)
    return out if cap is None else F.slice(out, 1, cap)


def line_products(text: Column, words=vocab.LINE_WORDS, cap: int | None = None) -> Column:
    """Lines that read like product titles: 10 < length < 150, three words, a keyword; distinct in order."""
    lines = F.array_distinct(F.transform(F.split(text, "\n"), lambda s: F.trim(s)))
    good = F.filter(lines, lambda s: (F.length(s) > 10) & (F.length(s) < 150) & (word_count(s) >= 3)
                    & ~s.startswith("http") & ~s.rlike(r"(?U)^[\d\W]+$") & has_any(F.lower(s), words))
    return good if cap is None else F.slice(good, 1, cap)


def sitemap_products(xml: Column, words=vocab.SITEMAP_WORDS, cap: int | None = None) -> Column:
    """array(struct(url, title)) of the product-like addresses of a sitemap; the title comes from the slug."""
    urls = F.transform(F.xpath(xml, F.lit('//*[local-name()="loc"]/text()')), lambda u: F.trim(u))
    good = F.filter(urls, lambda u: has_any(F.lower(u), words))
    out = F.transform(good, lambda u: F.struct(u.alias("url"), F.initcap(F.translate(F.element_at(
        F.split(F.regexp_replace(u, "/+$", ""), "/"), -1), "-_", "  ")).alias("title")))
    return out if cap is None else F.slice(out, 1, cap)


def same_site_links(html: Column, page_url: Column) -> Column:
    """Absolute links to the page's own host, distinct in order."""
    site = F.regexp_extract(page_url, r"^([a-zA-Z]+://[^/?#]+)", 1)
    own = host(page_url)
    hrefs = F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    absolute = F.transform(hrefs, lambda h: F.when(F.trim(h).startswith("/"), F.concat(site, F.trim(h)))
                           .when(F.trim(h).startswith("http"), F.trim(h)))
    return F.array_distinct(F.filter(absolute, lambda h: h.isNotNull() & F.contains(h, own)))


def operator_names(html: Column, noise=vocab.OPERATOR_NOISE, limit: int | None = None) -> Column:
    """Operator names: supplier elements, "supplied by" phrases, then JSON-LD providers; distinct, the first ``limit``
    where one is given."""
    marked = F.regexp_extract_all(html, F.lit(
        r'(?is)<[a-z0-9]+\b[^>]*(?:class\s*=\s*["\'][^"\']*(?:supplier|provider|operator|merchant)|data-supplier)[^>]*>([^<]*)<'), F.lit(1))
    phrases = F.regexp_extract_all(html, F.lit(
        r"(?i)(?:Supplied by|by|Operator:|Presented by)\s*([A-Z][A-Za-z0-9&\s\.,'-]+?)(?=\s{2,}|\.|,|$|<|Reviews|from|\d)"), F.lit(1))
    providers = F.transform(ld_items(html), lambda i: F.get_json_object(F.coalesce(i["provider"], i["organizer"]), "$.name"))
    names = F.transform(F.concat(marked, phrases, providers), lambda n: F.trim(n))
    good = F.filter(names, lambda n: n.isNotNull() & F.length(n).between(4, 85) & ~has_any(F.lower(n), noise))
    return F.array_distinct(good) if limit is None else F.slice(F.array_distinct(good), 1, limit)


def country_of_path(url: Column, slugs=vocab.COUNTRY_URL_SLUGS) -> Column:
    """Country of the first path segment that names one."""
    from bazaarflow.functions.rules import lit_map

    path = F.regexp_extract(F.lower(url), r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    found = F.filter(F.transform(F.split(path, "/"), lambda p: F.try_element_at(lit_map(slugs), p)), lambda c: c.isNotNull())
    return F.get(found, F.lit(0))


ITEM_FIELDS = ["nom_produit", "description", "canonical_activity_type", "service_type", "origin", "destination",
               "pays_raw", "prix_raw_text", "url_produit", "duree"]
ITEM_SCHEMA = "array<struct<" + ",".join(f"{f}:string" for f in ITEM_FIELDS) + ",error:string>>"
NULL_WORDS = ["null", "none", "unknown", ""]


def reply_json(reply: Column) -> Column:
    """The JSON text of a model reply: think blocks and code fences removed."""
    text = F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(text, r"```(?:json)?", ""))


def reply_items(reply: Column, min_length: int = 8, min_words: int = 2) -> Column:
    """Items of a reply: a list, or the ``products`` of an object; errors and short titles dropped.

    A broken reply gives an empty array.
    """
    text = reply_json(reply)
    body = F.when(text.startswith("["), text).otherwise(F.get_json_object(F.regexp_extract(text, r"(?s)\{.*\}", 0), "$.products"))
    items = F.coalesce(F.from_json(body, ITEM_SCHEMA), F.from_json(F.lit("[]"), ITEM_SCHEMA))
    title = lambda i: F.trim(F.coalesce(i["nom_produit"], F.lit("")))
    failed = lambda i: F.coalesce(i["error"], F.lit("false")).isin("true", "True")
    return F.filter(items, lambda i: i.isNotNull() & (F.length(title(i)) >= min_length) & (word_count(title(i)) >= min_words)
                    & ~failed(i))


def reply_place(reply: Column) -> Column:
    """struct(country, city, confidence) of a place reply; "null" words become null, confidence is clamped."""
    body = F.regexp_extract(reply_json(reply), r"(?s)\{.*\}", 0)
    data = F.from_json(body, "struct<detected_country:string,detected_city:string,confidence:string>")

    def clean(c):
        return F.when(~F.lower(c).isin(*NULL_WORDS), c)

    conf = F.coalesce(data["confidence"].try_cast("double"), F.lit(0.0))
    return F.struct(clean(data["detected_country"]).alias("country"), clean(data["detected_city"]).alias("city"),
                    F.round(F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0)), 2).alias("confidence"))


def is_garbage_title(title: Column, titles=vocab.GARBAGE_TITLES, patterns=vocab.GARBAGE_TITLE_PATTERNS,
                     min_length: int = 8, min_words: int = 2) -> Column:
    low = F.lower(F.trim(title))
    return (F.coalesce((F.length(title) < min_length) | (word_count(title) < min_words) | one_of(low, titles), F.lit(True))
            | matches_any(low, patterns))
