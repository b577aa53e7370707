"""Text cleaning and text features as native column expressions.

Length limits of the stored columns are parameters (``cap``): nothing is cut unless asked for.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarflow import vocab
from bazaarflow.functions.rules import ascii_classes, has_any, lit_array, lower_folded, matches_any, once, one_of, required_word

ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"),
            ("&apos;", "'")]
# Latin letters whose decomposition starts with one ASCII letter, and that letter.
_FOLDED = [(chr(n), unicodedata.normalize("NFKD", chr(n))[0]) for n in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
_FOLDED = [(c, base) for c, base in _FOLDED if base.isascii() and base != c and base.isalpha()]
ACCENTED, BASE = ("".join(x) for x in zip(*_FOLDED))


def present(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def cut(c: Column, cap: int | None) -> Column:
    return c if cap is None else F.substring(c, 1, cap)


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_patterns(c: Column, patterns) -> Column:
    """Replaces the patterns by a blank, one after the other, ignoring case.

    A pattern is only tried on texts that contain its word: a plain search is far cheaper than a pass of the
    regular expression. Blanks never join two letters, so the words can be looked up in the original text.
    """
    rules = F.arrays_zip(lit_array([required_word(p) or "" for p in patterns]).alias("word"),
                         lit_array([f"(?i){ascii_classes(p, fold=True)}" for p in patterns]).alias("pattern"))

    def step(low: Column):
        return lambda v, r: F.when(F.contains(low, r["word"]), F.regexp_replace(v, r["pattern"], F.lit(" "))).otherwise(v)

    return once(c, lambda v: once(lower_folded(v), lambda low: F.aggregate(rules, v, step(low))))


def drop_tags(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, "<[^>]+>", " "))


def decode_entities(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def strip_html(c: Column, cap: int | None = None) -> Column:
    """Script and style blocks, then tags, then entities, then white space."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return cut(squeeze(decode_entities(F.regexp_replace(c, "<[^>]+>", " "))), cap)


def page_text(html: Column, elements=vocab.NOISE_ELEMENTS, cap: int | None = None) -> Column:
    """Readable text of a page: whole noise elements and comments go first, then strip_html."""
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    html = F.regexp_replace(html, r"(?is)<(" + "|".join(elements) + r")\b[^>]*>.*?</\1>", " ")
    return strip_html(html, cap)


def drop_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def light_clean(c: Column, cap: int | None = None) -> Column:
    return cut(drop_control(drop_tags(F.coalesce(c, F.lit("")))), cap)


def marketing_title(c: Column, brands=vocab.TITLE_BRANDS, cap: int | None = None) -> Column:
    """Drops years, trailing marketplace names and characters outside the title alphabet."""
    c = F.regexp_replace(c, r"(?U)\b20\d{2}\b", "")
    for brand in brands:
        c = F.regexp_replace(c, rf"(?iU)\s*[-|]\s*{re.escape(brand)}\s*$", "")
    return cut(squeeze(F.regexp_replace(c, r"(?U)[^\w\s\-.,!?()&/éèêëàâùûüôîïç]", "")), cap)


def navigation_title(c: Column, noise=vocab.NAVIGATION_NOISE, min_length=vocab.MIN_CLEAN_TITLE) -> Column:
    """Title without navigation fragments; empty when too short."""
    c = strip_html(F.coalesce(c, F.lit("")))
    for pattern in noise:
        c = F.trim(F.regexp_replace(c, "(?i)" + ascii_classes(pattern, fold=True), ""))
    c = F.trim(F.regexp_replace(c, r"^[\s|>\-»]+|[\s|>\-«]+$", ""))
    c = squeeze(F.regexp_replace(c, r"^[A-Z][a-z]\s+[A-Z][a-z]\s+", ""))
    return once(c, lambda x: F.when(F.length(x) < min_length, F.lit("")).otherwise(x))


def clean_description(c: Column, noise=(*vocab.BOOKING_NOISE, *vocab.SEO_NOISE), min_sentence: int = 20,
                      min_length=vocab.MIN_CLEAN_DESCRIPTION) -> Column:
    """Description without booking and search noise; keeps sentences longer than ``min_sentence``."""
    c = blank_patterns(strip_html(F.coalesce(c, F.lit(""))), noise)
    sentences = F.transform(F.split(c, r"\."), lambda s: F.trim(s))
    kept = F.array_join(F.filter(sentences, lambda s: F.length(s) > min_sentence), ". ")
    return once(squeeze(kept), lambda x: F.when(F.length(x) < min_length, F.lit("")).otherwise(x))


def without_marketing(c: Column, phrases=vocab.MARKETING_PHRASES, cap: int | None = None) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"https?://\S+", "")
    return cut(squeeze(F.regexp_replace(c, "(?i)" + "|".join(phrases), "")), cap)


def alpha_ratio(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\P{L}", "")) / F.greatest(F.length(c), F.lit(1))


def is_good_title(c: Column, noise=vocab.NAVIGATION_NOISE, min_length=vocab.MIN_CLEAN_TITLE) -> Column:
    return (F.coalesce(F.length(c) >= min_length, F.lit(False)) & ~matches_any(c, noise, "(?i)")
            & F.coalesce(alpha_ratio(c) > 0.5, F.lit(False)))


def is_good_line(c: Column, noise=(*vocab.BOOKING_NOISE, *vocab.NAVIGATION_NOISE), min_length: int = 15) -> Column:
    return F.coalesce(F.length(c) >= min_length, F.lit(False)) & ~matches_any(c, noise, "(?i)")


def markdown_product(md: Column, max_lines: int | None = None) -> Column:
    """struct(title, description, images) of a markdown page.

    Title: first good H1/H2. Description: the good lines after it (the first ``max_lines`` where that is given); a
    page without heading has neither. Both get the noise cleaning.
    """
    lines = F.filter(F.transform(F.split(md, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    tagged = F.transform(lines, lambda s, i: F.struct(
        i.alias("pos"), s.alias("line"), s.rlike(r"^##? ").alias("heading"),
        F.trim(F.regexp_replace(s, r"^##? ", "")).alias("head")))

    def product(rows: Column, title: Column) -> Column:
        # A later H1 never counts as text.
        body = F.filter(rows, lambda x: (x["pos"] > title["pos"]) & ~x["line"].startswith("# ") & is_good_line(x["line"]))
        kept = F.transform(body, lambda x: x["line"])
        text = F.array_join(kept if max_lines is None else F.slice(kept, 1, max_lines), " ")
        return F.struct(
            navigation_title(title["head"]).alias("title"),
            F.when(title.isNull(), F.lit("")).otherwise(clean_description(text)).alias("description"))

    def first_title(rows: Column) -> Column:
        return F.try_element_at(F.filter(rows, lambda x: x["heading"] & is_good_title(x["head"])), F.lit(1))

    parts = once(tagged, lambda rows: once(first_title(rows), lambda title: product(rows, title)))
    return F.struct(parts["title"].alias("title"), parts["description"].alias("description"),
                    F.regexp_extract_all(md, F.lit(r"!\[.*?\]\((https?://[^\)]+)\)"), 1).alias("images"))


def fold(c: Column) -> Column:
    """Accents removed; other characters outside ASCII dropped."""
    return F.regexp_replace(F.translate(c, ACCENTED, BASE), r"[^\x00-\x7f]", "")


def slug_text(c: Column) -> Column:
    c = F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), ACCENTED, BASE)
    return squeeze(F.regexp_replace(c, r"[^a-z0-9\s]", " "))


def host(url: Column) -> Column:
    """Host of a URL or bare address, lower case, without www; empty on null."""
    c = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), "https?://", "")
    c = F.regexp_replace(c, r"^www\.", "")
    return F.trim(F.regexp_extract(c, r"^([^/?#]*)", 1))


def ascii_words(c: Column, min_length: int) -> Column:
    """Distinct whole words made of a-z only, at least ``min_length`` letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(rf"(?U)\b[a-z]{{{min_length},}}\b"), F.lit(0)))


def english_share(c: Column, words=vocab.ENGLISH_WORDS) -> Column:
    found = ascii_words(c, 1)
    return F.size(F.array_intersect(found, lit_array(words))) / F.nullif(F.size(found), F.lit(0))


def is_likely_english(c: Column, words=vocab.ENGLISH_WORDS, share: float = 0.25) -> Column:
    return F.when(c.isNull() | (F.length(c) < 5), F.lit(True)).otherwise(
        F.coalesce(english_share(c, words) > share, F.lit(False)))


def format_currency(amount: Column, currency: Column) -> Column:
    code = F.upper(currency)
    symbol = (F.when(code == "EUR", "€").when(code == "USD", "$").when(code == "GBP", "£").otherwise(currency))
    return F.when(amount.isNull(), F.lit("N/A")).otherwise(
        F.concat(F.format_string("%.2f", amount), F.lit(" "), symbol))


def ellipsize(c: Column, max_length: int = 100) -> Column:
    return F.when(F.length(c) > max_length, F.concat(F.substring(c, 1, max_length), F.lit("..."))).otherwise(
        F.coalesce(c, F.lit("")))


def _labelled(prefix: str, c: Column) -> Column:
    return F.when(present(c), F.concat(F.lit(prefix), c))


def embedding_text(title: Column, description: Column, city: Column, country: Column, activity: Column,
                   category: Column, cap: int | None = None) -> Column:
    """Supplier product text: labelled parts in a fixed order."""
    place = F.concat(F.coalesce(blank_to_null(city), F.lit("Unknown")), F.lit(", "),
                     F.coalesce(blank_to_null(country), F.lit("Unknown")))
    return F.concat_ws(
        " | ", F.concat(F.lit("Activity: "), title), F.concat(F.lit("Location: "), place),
        F.concat(F.lit("Type: "), activity), F.concat(F.lit("Category: "), category),
        F.nullif(cut(drop_tags(description), cap), F.lit("")))


def catalog_embedding_text(title: Column, title_en: Column, description: Column, city: Column, country: Column,
                           activity: Column, category: Column, cap: int | None = None) -> Column:
    """Catalogue text: English title first, then place, type, category, description."""
    place = F.trim(F.concat(F.coalesce(city, F.lit("")), F.lit(" "), F.coalesce(country, F.lit(""))))
    return F.concat_ws(" | ", F.coalesce(blank_to_null(title_en), blank_to_null(title)),
                       F.nullif(place, F.lit("")), blank_to_null(activity), blank_to_null(category),
                       F.nullif(cut(drop_tags(description), cap), F.lit("")))


def service_embedding_text(service: Column, family: Column, origin: Column, destination: Column, city: Column,
                           country: Column, flag_names: Column, tag_names: Column | None, title: Column,
                           description: Column, cap: int | None = None, tag_limit: int | None = None) -> Column:
    """service:/theme:/from:/to:/city:/country:/flags:/tags: parts, then title and description.

    ``tag_names=None`` gives the variant without tags.
    """
    parts = [_labelled("service:", service), _labelled("theme:", family), _labelled("from:", origin),
             _labelled("to:", destination), _labelled("city:", city), _labelled("country:", country),
             F.when(F.size(flag_names) > 0, F.concat(F.lit("flags:"), F.array_join(flag_names, ",")))]
    if tag_names is not None:
        shown = tag_names if tag_limit is None else F.slice(tag_names, 1, tag_limit)
        parts.append(F.when(F.size(tag_names) > 0, F.concat(F.lit("tags:"), F.array_join(shown, ","))))
    return F.concat_ws(" | ", *parts, blank_to_null(title), F.nullif(cut(description, cap), F.lit("")))


def entity_embedding_text(service: Column, city: Column, country: Column, family: Column, title: Column,
                          description: Column, cap: int | None = None) -> Column:
    return F.concat_ws(" | ", _labelled("service:", service), _labelled("city:", city),
                       _labelled("country:", country), _labelled("theme:", family), blank_to_null(title),
                       F.nullif(cut(description, cap), F.lit("")))


def signature(city: Column, activity: Column, title: Column, stop=vocab.SIGNATURE_STOP, shown: int | None = None) -> Column:
    """``city|type|first three title words`` (its first ``shown`` characters where that is given) plus the start of its md5."""
    words = F.filter(F.split(F.lower(title), r"\s+"),
                     lambda w: (w != "") & ~one_of(w, stop))
    key = F.concat(F.lower(F.coalesce(city, F.lit(""))), F.lit("|"), activity, F.lit("|"),
                   F.array_join(F.slice(words, 1, 3), " "))
    return F.concat(cut(key, shown), F.lit("_"), F.substring(F.md5(key), 1, 16))


def supplier_text(name: Column, city: Column, activity: Column, has_channel: Column, cap: int | None = None) -> Column:
    return cut(F.concat_ws(" ", blank_to_null(name), _labelled("located in ", city), _labelled("offering ", activity),
                           F.when(has_channel, F.lit("online booking available"))), cap)


def product_text(title: Column, description: Column, city: Column, cap: int | None = None) -> Column:
    return cut(F.concat_ws(" ", blank_to_null(title), F.nullif(description, F.lit("")), _labelled("in ", city)), cap)


PRICE_MENTIONS = [
    r"(?:from|à partir de|depuis|prix|price|cost|tarif)[\s:]*([\d,\.]+\s*(?:EUR|USD|€|\$|£|TND|MAD)?)",
    r"([\d,\.]+\s*(?:EUR|USD|€|\$|£|TND|MAD))", r"(?:€|\$|£)([\d,\.]+)"]
DURATION_MENTIONS = [
    r"(\d+(?:\.\d+)?)\s*(?:hour[s]?|heure[s]?|hr[s]?|h)\b", r"(\d+)\s*(?:minute[s]?|min)\b",
    r"(\d+)\s*(?:day[s]?|jour[s]?|jours?)\b", r"(?:duration|durée|dure|lasting)[\s:]*([^\.\n]{3,30})"]
CITY_MENTIONS = [r"\bin\s+([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]+)?)\b", r"\bfrom\s+([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]+)?)\b",
                 r"([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]+)?)\s+(?:tour|excursion|transfer|trip)"]


def first_mention(c: Column, patterns) -> Column:
    """Whole match of the first pattern that occurs, else empty."""
    found = [F.nullif(F.trim(F.regexp_extract(c, "(?i)" + p, 0)), F.lit("")) for p in patterns]
    return F.coalesce(*found, F.lit(""))


def city_mentions(c: Column, limit: int | None = None) -> Column:
    """Capitalised places after in/from or before a product word; distinct ignoring case, in order."""
    found = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in CITY_MENTIONS])
    unique = F.filter(found, lambda x, i: F.array_position(
        F.transform(found, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    return unique if limit is None else F.slice(unique, 1, limit)


def mentions(c: Column, keywords=vocab.MENTION_KEYWORDS) -> Column:
    return F.struct(
        first_mention(c, PRICE_MENTIONS).alias("price_text"),
        first_mention(c, DURATION_MENTIONS).alias("duration_text"),
        city_mentions(c).alias("cities"),
        once(F.lower(c), lambda low: F.filter(lit_array(keywords), lambda k: F.contains(low, k))).alias("keywords"))


def is_attraction(c: Column, words=vocab.ATTRACTION_WORDS) -> Column:
    return has_any(F.lower(c), words)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))
