"""Queries: text cleaning and gates."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from bazaarflow import vocab
from bazaarflow.functions import pages, rules, text
from bazaarflow.operators import dedup, geo, reports
from bazaarflow.plans import inputs, normalise
from bazaarflow.plans.registry import query
from bazaarflow.plans.sqltext import any_match, any_of, case_patterns, hits, in_list, quoted, words

c = F.col


def sql_replace(expr: str, pattern: str, by: str = "''", options: str = "g") -> str:
    return f"regexp_replace({expr}, {quoted(pattern)}, {by}, {quoted(options)})"


def sql_squeeze(expr: str) -> str:
    return "trim(" + sql_replace(expr, r"\s+", "' '") + ")"


def sql_strip(expr: str) -> str:
    for element in ("script", "style"):
        expr = sql_replace(expr, rf"<{element}[^>]*>.*?</{element}>", "' '", "gis")
    expr = sql_replace(expr, "<[^>]+>", "' '")
    for a, b in text.ENTITIES:
        expr = f"replace({expr}, {quoted(a)}, {quoted(b)})"
    return sql_squeeze(expr)


def sql_page(expr: str) -> str:
    expr = sql_replace(expr, "<!--.*?-->", "' '", "gs")
    for element in vocab.NOISE_ELEMENTS:
        expr = sql_replace(expr, rf"<{element}\b[^>]*>.*?</{element}>", "' '", "gis")
    return sql_strip(expr)


def sql_drop_tags(expr: str) -> str:
    return sql_squeeze(sql_replace(expr, "<[^>]+>", "' '"))


@query("txt1_page_text", f"SELECT page_id, {sql_page('html')} AS text, {sql_strip('html')} AS stripped FROM pages")
def _(t):
    return t.pages.select("page_id", text.page_text(c("html")).alias("text"), text.strip_html(c("html")).alias("stripped"))


@query("txt2_control_characters", "SELECT doc_id, replace(text, chr(10), ' ') || '|' || CAST(length(text) AS STRING) AS clean FROM documents")
def _(t):
    dirty = F.concat(F.lit("\x01"), F.replace(c("text"), F.lit("\n"), F.lit("\x07 ")), F.lit("\x1f"))
    return t.documents.select("doc_id", F.concat(text.drop_control(dirty), F.lit("|"), F.length("text").cast("string")).alias("clean"))


_marketing = "regexp_replace(title, '\\b20\\d{2}\\b', '', 'g')"
for _b in vocab.TITLE_BRANDS:
    _marketing = sql_replace(_marketing, rf"\s*[-|]\s*{re.escape(_b)}\s*$", "''", "i")
_marketing = sql_squeeze(sql_replace(_marketing, r"[^\p{L}\p{N}_\s\-.,!?()&/]"))


@query("txt3_marketing_title", f"WITH {inputs.RAW_SQL} SELECT product_id, {_marketing} AS clean_title FROM raw")
def _(t):
    return inputs.raw(t).select("product_id", text.marketing_title(c("title")).alias("clean_title"))


_heading = "regexp_extract(html, '<h1>(.*?)</h1>', 1)"
_nav = sql_strip("raw_title")
for _p in vocab.NAVIGATION_NOISE:
    _nav = "trim(" + sql_replace(_nav, _p, "''", "gi") + ")"
_nav = "trim(" + sql_replace(_nav, r"^[\s|>\-»]+|[\s|>\-«]+$") + ")"
_nav = sql_squeeze(sql_replace(_nav, r"^[A-Z][a-z]\s+[A-Z][a-z]\s+"))


@query("txt4_navigation_title", f"""
WITH t AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Home > ' WHEN 1 THEN 'Menu ' ELSE '' END || {_heading} AS raw_title FROM pages),
n AS (SELECT page_id, {_nav} AS s FROM t)
SELECT page_id, CASE WHEN length(s) < 10 THEN '' ELSE s END AS clean_title FROM n""")
def _(t):
    prefix = F.expr("CASE page_id % 3 WHEN 0 THEN 'Home > ' WHEN 1 THEN 'Menu ' ELSE '' END")
    title = F.concat(prefix, F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1))
    return t.pages.select("page_id", text.navigation_title(title).alias("clean_title"))


def sql_description(expr: str) -> str:
    d = sql_strip(expr)
    for p in (*vocab.BOOKING_NOISE, *vocab.SEO_NOISE):
        d = sql_replace(d, p, "' '", "gi")
    kept = f"list_filter(list_transform(string_split({d}, '.'), lambda s: trim(s)), lambda s: length(s) > 20)"
    return sql_squeeze(f"coalesce(array_to_string({kept}, '. '), '')")


@query("txt5_clean_description", f"""
WITH {inputs.RAW_SQL}, x AS (SELECT product_id AS id, 'raw' AS kind, {sql_description("description")} AS s FROM raw
UNION ALL SELECT doc_id, 'doc', {sql_description("text")} FROM documents)
SELECT id, kind, CASE WHEN length(s) < 30 THEN '' ELSE s END AS clean FROM x""")
def _(t):
    raw = inputs.raw(t).select(c("product_id").alias("id"), F.lit("raw").alias("kind"), c("description").alias("d"))
    docs = t.documents.select(c("doc_id").alias("id"), F.lit("doc").alias("kind"), c("text").alias("d"))
    return raw.unionByName(docs).select("id", "kind", text.clean_description(c("d")).alias("clean"))


_phrases = sql_squeeze(sql_replace(sql_replace(sql_replace("d", "<[^>]+>", "' '"), r"https?://\S+"),
                                   "|".join(vocab.MARKETING_PHRASES), "''", "gi"))


@query("txt6_without_marketing", f"""
WITH x AS (SELECT doc_id, 'Book now ' || text || ' see https://shop.example.com/a?b=1 best price' AS d FROM documents)
SELECT doc_id, {_phrases} AS clean FROM x""")
def _(t):
    d = F.concat(F.lit("Book now "), c("text"), F.lit(" see https://shop.example.com/a?b=1 best price"))
    return t.documents.select("doc_id", text.without_marketing(d).alias("clean"))


_alpha = "CAST(length(regexp_replace(line, '\\P{L}', '', 'g')) AS DOUBLE) / greatest(length(line), 1)"


@query("txt7_quality_predicates", f"""
WITH x AS (SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, pos, (length(line) >= 10 AND NOT {any_match('line', vocab.NAVIGATION_NOISE, 'i')} AND {_alpha} > 0.5) AS good_title,
 (length(line) >= 15 AND NOT {any_match('line', (*vocab.BOOKING_NOISE, *vocab.NAVIGATION_NOISE), 'i')}) AS good_line FROM x""")
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", text.is_good_title(c("line")).alias("good_title"), text.is_good_line(c("line")).alias("good_line"))


@query("txt8_markdown_product", """
SELECT doc_id, 'The little guide of ' || source AS title, 1 AS n_images, 'https://img.example.com/' || CAST(doc_id AS STRING) || '.png' AS image,
 'This is the first paragraph about ' || source || '. It has more than enough words' AS description FROM documents""")
def _(t):
    md = F.concat(F.lit("Menu\n## x\n# The little guide of "), c("source"), F.lit("\n\nThis is the first paragraph about "), c("source"),
                  F.lit(".\nshort\nIt has more than enough words.\n![pic](https://img.example.com/"), c("doc_id").cast("string"),
                  F.lit(".png)\n# Another heading of the page\nMenu of the site\n"))
    md = F.replace(md, F.lit("![pic]"), F.lit("\n![pic]"))
    p = text.markdown_product(md)
    # The image line is a good description line as well; the noise cleaning keeps its sentences over 20 characters.
    return t.documents.select("doc_id", p["title"].alias("title"), F.size(p["images"]).alias("n_images"), p["images"][0].alias("image"),
                              F.regexp_extract(p["description"], r"^(.*?words)", 1).alias("description"))


@query("txt9_slug_text", f"""
SELECT doc_id, {sql_squeeze(sql_replace("strip_accents(lower(trim(text)))", r"[^a-z0-9\s]", "' '"))} AS slug FROM documents""")
def _(t):
    return t.documents.select("doc_id", text.slug_text(c("text")).alias("slug"))


_host = r"regexp_extract(regexp_replace(regexp_replace(lower(trim(url)), 'https?://', ''), '^www\.', ''), '^([^/?#]*)', 1)"


@query("txt10_host", f"SELECT page_id, {_host} AS host FROM pages")
def _(t):
    return t.pages.select("page_id", text.host(c("url")).alias("host"))


@query("txt11_likely_english", f"""
WITH x AS (SELECT doc_id, text, {words('text', 1)} AS w FROM documents)
SELECT doc_id, CASE WHEN text IS NULL OR length(text) < 5 THEN true WHEN len(w) = 0 THEN false
 ELSE CAST(len(list_intersect(w, [{', '.join(map(quoted, vocab.ENGLISH_WORDS))}])) AS DOUBLE) / len(w) > 0.25 END AS english FROM x""")
def _(t):
    return t.documents.select("doc_id", text.is_likely_english(c("text")).alias("english"))


@query("txt12_canonical_schema", f"""
WITH {inputs.RAW_SQL}, {inputs.CATALOG_SQL}
SELECT coalesce(name_en, name) AS title, description, city, country, price * 0.8 AS price_min, price * 1.2 AS price_max, 'EUR' AS currency,
 '' AS operator, 'CATALOG' AS source, catalog_id AS source_id, CAST(NULL AS STRING) AS url FROM catalog
UNION ALL
SELECT title, description, coalesce(city_raw, ''), coalesce(country_raw, ''), price, CAST(NULL AS DOUBLE), coalesce(currency, 'EUR'), source,
 'SCRAPED', product_id, url FROM raw""")
def _(t):
    null = lambda ty: F.lit(None).cast(ty)
    cat = inputs.catalog(t).select(
        c("catalog_id").alias("product_id"), "catalog_id", "name_en", "name", null("string").alias("first_name"), null("string").alias("raw_title"),
        null("string").alias("clean_title"), "description", "city", "country", (c("price") * 0.8).alias("min_price"),
        (c("price") * 1.2).alias("max_price"), null("double").alias("price"), null("double").alias("price_max"),
        null("double").alias("estimated_price"), null("string").alias("currency"), null("string").alias("operator"), null("string").alias("url"))
    raw = inputs.raw(t).select(
        "product_id", null("bigint").alias("catalog_id"), null("string").alias("name_en"), null("string").alias("name"),
        null("string").alias("first_name"), c("title").alias("raw_title"), null("string").alias("clean_title"), "description",
        c("city_raw").alias("city"), c("country_raw").alias("country"), null("double").alias("min_price"), null("double").alias("max_price"),
        "price", null("double").alias("price_max"), null("double").alias("estimated_price"), "currency", c("source").alias("operator"), "url")
    return normalise.canonical(cat.unionByName(raw))


@query("txt13_display", f"""
WITH {inputs.RAW_SQL}
SELECT product_id, CASE WHEN price IS NULL THEN 'N/A' ELSE printf('%.2f', price) || ' ' || CASE upper(currency) WHEN 'EUR' THEN '€'
 WHEN 'USD' THEN '$' WHEN 'GBP' THEN '£' ELSE currency END END AS shown,
 CASE WHEN length(title) > 20 THEN substr(title, 1, 20) || '...' ELSE coalesce(title, '') END AS short_title FROM raw""")
def _(t):
    return inputs.raw(t).select("product_id", text.format_currency(c("price"), c("currency")).alias("shown"),
                                text.ellipsize(c("title"), 20).alias("short_title"))


_desc = sql_drop_tags("description")


def sql_first_parts(*parts: str) -> str:
    return "concat_ws(' | ', " + ", ".join(parts) + ")"


@query("txt14_embedding_texts", f"""
WITH {inputs.CATALOG_SQL}
SELECT catalog_id,
 {sql_first_parts("'Activity: ' || name", "'Location: ' || city || ', ' || country", "'Type: ' || activity",
                  "'Category: ' || category", f"nullif({_desc}, '')")} AS product_text,
 {sql_first_parts("coalesce(name_en, name)", "city || ' ' || country", "activity", "category", f"nullif({_desc}, '')")} AS catalog_text,
 {sql_first_parts("'service:' || activity", "'theme:' || category", "'city:' || city", "'country:' || country",
                  "CASE WHEN contains(lower(name), 'tour') THEN 'flags:guided' END", "name", "nullif(description, '')")} AS service_text,
 {sql_first_parts("'service:' || activity", "'theme:' || category", "'city:' || city", "'country:' || country",
                  "CASE WHEN contains(lower(name), 'tour') THEN 'flags:guided' END",
                  "CASE WHEN contains(lower(name), 'boat') THEN 'tags:water' END", "name", "nullif(description, '')")} AS tagged_text,
 {sql_first_parts("'service:' || activity", "'city:' || city", "'country:' || country", "'theme:' || category", "name",
                  "nullif(description, '')")} AS entity_text FROM catalog""")
def _(t):
    cat = inputs.catalog(t)
    none = F.lit(None).cast("string")
    flags = F.array_compact(F.array(F.when(F.contains(F.lower("name"), F.lit("tour")), F.lit("guided"))))
    tags = F.array_compact(F.array(F.when(F.contains(F.lower("name"), F.lit("boat")), F.lit("water"))))
    args = [c("activity"), c("category"), none, none, c("city"), c("country"), flags]
    return cat.select(
        "catalog_id",
        text.embedding_text(c("name"), c("description"), c("city"), c("country"), c("activity"), c("category")).alias("product_text"),
        text.catalog_embedding_text(c("name"), c("name_en"), c("description"), c("city"), c("country"), c("activity"), c("category")).alias("catalog_text"),
        text.service_embedding_text(*args, None, c("name"), c("description")).alias("service_text"),
        text.service_embedding_text(*args, tags, c("name"), c("description")).alias("tagged_text"),
        text.entity_embedding_text(c("activity"), c("city"), c("country"), c("category"), c("name"), c("description")).alias("entity_text"))


def sql_signature(city: str, activity: str, title: str, stop) -> str:
    kept = f"list_filter(string_split_regex(lower({title}), '\\s+'), lambda w: w <> '' AND NOT {in_list('w', stop)})"
    return f"lower(coalesce({city}, '')) || '|' || {activity} || '|' || array_to_string({kept}[1:3], ' ')"


@query("txt15_matching_signature", f"""
WITH {inputs.CATALOG_SQL}, k AS (SELECT catalog_id, {sql_signature('city', 'activity', 'name', vocab.SIGNATURE_STOP)} AS a,
 {sql_signature('city', 'activity', 'name_en', vocab.CATALOG_SIGNATURE_STOP)} AS b FROM catalog)
SELECT catalog_id, a || '_' || substr(md5(a), 1, 16) AS signature,
 b || '_' || substr(md5(b), 1, 16) AS catalog_signature FROM k""")
def _(t):
    return inputs.catalog(t).select("catalog_id", text.signature(c("city"), c("activity"), c("name")).alias("signature"),
                                    text.signature(c("city"), c("activity"), c("name_en"), vocab.CATALOG_SIGNATURE_STOP).alias("catalog_signature"))


@query("txt16_relation_texts", f"""
WITH {inputs.CATALOG_SQL}
SELECT catalog_id, name || ' located in ' || city || ' offering ' || activity || CASE WHEN catalog_id % 2 = 0 THEN ' online booking available' ELSE '' END AS supplier_text,
 name || ' ' || description || ' in ' || city AS product_text FROM catalog""")
def _(t):
    return inputs.catalog(t).select(
        "catalog_id", text.supplier_text(c("name"), c("city"), c("activity"), c("catalog_id") % 2 == 0).alias("supplier_text"),
        text.product_text(c("name"), c("description"), c("city")).alias("product_text"))


_kw = ", ".join(f"CASE WHEN contains(lower(d), {quoted(k)}) THEN {quoted(k)} END" for k in vocab.MENTION_KEYWORDS)


@query("txt17_mentions", f"""
WITH {inputs.RAW_SQL}, x AS (SELECT product_id, regexp_replace(title || '. ' || description, '<[^>]+>', ' ', 'g') AS d FROM raw)
SELECT product_id, coalesce({", ".join(f"nullif(trim(regexp_extract(d, {quoted('(?i)' + p)}, 0)), '')" for p in text.PRICE_MENTIONS)}, '') AS price_text,
 coalesce({", ".join(f"nullif(trim(regexp_extract(d, {quoted('(?i)' + p)}, 0)), '')" for p in text.DURATION_MENTIONS)}, '') AS duration_text,
 array_to_string(list_filter([{_kw}], lambda k: k IS NOT NULL), ',') AS keywords FROM x""")
def _(t):
    d = F.regexp_replace(F.concat(c("title"), F.lit(". "), c("description")), "<[^>]+>", " ")
    m = text.mentions(c("_d"))
    return inputs.raw(t).withColumn("_d", d).select("product_id", m["price_text"].alias("price_text"), m["duration_text"].alias("duration_text"),
                                F.array_join(m["keywords"], ",").alias("keywords"))


_wc = lambda e: f"len(list_filter(string_split_regex(trim({e}), '\\s+'), lambda w: w <> ''))"


@query("flt1_product_gate", f"""
WITH {inputs.RAW_SQL}
SELECT product_id, CASE WHEN trim(title) = '' THEN 'missing' WHEN length(trim(title)) < 8 THEN 'short'
 WHEN {in_list('lower(trim(title))', vocab.JUNK_TITLES)} THEN 'junk_title'
 WHEN {any_match('lower(trim(title))', vocab.JUNK_TITLE_PATTERNS)} THEN 'junk_pattern' WHEN {_wc('title')} < 2 THEN 'single_word' END AS reject_reason,
 CASE WHEN NOT ({in_list("lower(trim(city_raw))", vocab.JUNK_CITIES)} OR {_wc('city_raw')} > 4) THEN city_raw END AS city_raw,
 nullif(country_raw, '') AS country_raw FROM raw""")
def _(t):
    return normalise.gate_products(inputs.raw(t)).select("product_id", "reject_reason", "city_raw", "country_raw")


@query("flt2_garbage_title", f"""
WITH x AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Gift shop' WHEN 1 THEN 'Book now' WHEN 2 THEN 'All ' || source ELSE text END AS title FROM documents)
SELECT doc_id, (length(title) < 8 OR {_wc('title')} < 2 OR {in_list('lower(trim(title))', vocab.GARBAGE_TITLES)}
 OR {any_match('lower(trim(title))', vocab.GARBAGE_TITLE_PATTERNS)}) AS garbage FROM x""")
def _(t):
    title = F.expr("CASE doc_id % 5 WHEN 0 THEN 'Gift shop' WHEN 1 THEN 'Book now' WHEN 2 THEN 'All ' || source ELSE text END")
    return t.documents.select("doc_id", pages.is_garbage_title(title).alias("garbage"))


def sql_garbage_city(city: str) -> str:
    low = f"lower(trim({city}))"
    return (f"(coalesce(length({low}) <= 2, true) OR {in_list(low, vocab.GARBAGE_CITY_WORDS)} OR {in_list(low, vocab.COUNTRY_AS_CITY)}"
            f" OR ({any_of(low, vocab.CITY_ATTRACTION_WORDS)} AND {_wc(low)} > 1))")


@query("flt3_garbage_city", f"WITH {inputs.RAW_SQL} SELECT product_id, {sql_garbage_city('city_raw')} AS garbage FROM raw")
def _(t):
    return inputs.raw(t).select("product_id", geo.is_garbage_city(c("city_raw")).alias("garbage"))


@query("flt4_attraction_name", f"WITH {inputs.RAW_SQL} SELECT product_id, {any_of('lower(title)', vocab.ATTRACTION_WORDS)} AS attraction FROM raw")
def _(t):
    return inputs.raw(t).select("product_id", text.is_attraction(c("title")).alias("attraction"))


_LEADS = f"""leads AS (SELECT page_id AS seq, CASE page_id % 6 WHEN 0 THEN 'Grand Mall' WHEN 1 THEN 'AB' ELSE 'Sunny Tours ' || CAST(page_id AS STRING) END AS name,
 CASE WHEN page_id % 7 = 0 THEN 'https://www.facebook.com/x' ELSE url END AS website FROM pages)"""


def _leads(t):
    return t.pages.selectExpr(
        "page_id AS seq", "CASE page_id % 6 WHEN 0 THEN 'Grand Mall' WHEN 1 THEN 'AB' ELSE 'Sunny Tours ' || CAST(page_id AS STRING) END AS name",
        "CASE WHEN page_id % 7 = 0 THEN 'https://www.facebook.com/x' ELSE url END AS website")


@query("flt5_supplier_candidates", f"""
WITH {_LEADS}, h AS (SELECT *, {_host.replace('url', 'website')} AS domain FROM leads),
known AS (SELECT DISTINCT 'm.' || regexp_replace({_host}, '^(m|blog)\\.', '') AS domain FROM pages),
ok AS (SELECT * FROM h WHERE length(trim(name)) >= 3 AND length(domain) >= 5 AND NOT {any_of('domain', vocab.SKIP_DOMAINS)}
 AND NOT {any_of('lower(name)', vocab.NOT_SUPPLIER_WORDS)} AND domain NOT IN (SELECT domain FROM known))
SELECT domain, min(seq) AS seq, arg_min(name, seq) AS name FROM ok GROUP BY domain""")
def _(t):
    known = t.pages.select(F.concat(F.lit("m."), F.regexp_replace(text.host(c("url")), r"^(m|blog)\.", "")).alias("domain")).distinct()
    return dedup.supplier_candidates(_leads(t), known).select("domain", "seq", "name")


@query("flt6_travel_supplier", f"WITH {_LEADS} SELECT seq, {any_of('lower(name)', vocab.TRAVEL_WORDS)} AS travel FROM leads")
def _(t):
    return _leads(t).select("seq", pages.is_travel_supplier(c("name")).alias("travel"))


@query("flt7_connected", f"WITH {inputs.SUPPLIERS_SQL} SELECT supplier_id, connection FROM suppliers WHERE has_api OR has_channel")
def _(t):
    return inputs.suppliers(t).where(pages.is_connected(c("has_api"), c("has_channel"))).select("supplier_id", "connection")


def sql_product_url(url: str) -> str:
    low = f"lower({url})"
    asset = " OR ".join(f"ends_with({low}, {quoted(e)}) OR contains({low}, {quoted(e + '?')})" for e in vocab.REJECT_EXTENSIONS)
    return f"(NOT ({asset}) AND NOT {any_match(low, vocab.REJECT_URL_PATTERNS)} AND {any_match(low, vocab.PRODUCT_PATH_PATTERNS)})"


@query("flt8_product_url", f"""
WITH {inputs.RAW_SQL} SELECT product_id AS id, 'raw' AS kind, {sql_product_url('url')} AS product_url FROM raw
UNION ALL SELECT page_id, 'page', {sql_product_url('url')} FROM pages""")
def _(t):
    rows = inputs.raw(t).select(c("product_id").alias("id"), F.lit("raw").alias("kind"), "url").unionByName(
        t.pages.select(c("page_id").alias("id"), F.lit("page").alias("kind"), "url"))
    return rows.select("id", "kind", pages.is_product_url(c("url")).alias("product_url"))


_signals = hits("lower(html)", [s.lower() for s in vocab.PAGE_CONTENT_SIGNALS])


@query("flt9_page_type", f"""
WITH {inputs.RAW_SQL}, u AS (SELECT page_id AS id, url, html || CASE WHEN page_id % 3 = 0 THEN '<a class="book-now" data-price>Booking</a>' ELSE '' END AS html FROM pages
UNION ALL SELECT product_id + 1000000, url, '' FROM raw)
SELECT id, {case_patterns('lower(url)', [*vocab.PAGE_TYPES, *[(p, 'PRODUCT') for p in vocab.PAGE_PRODUCT_PATTERNS]], 'UNKNOWN')} AS page_type,
 NOT {any_match('lower(url)', vocab.PAGE_OTHER_PATTERNS)} AND ({any_match('lower(url)', vocab.PAGE_PRODUCT_PATTERNS)} OR {_signals} >= 2) AS product_page FROM u""")
def _(t):
    html = F.expr("""html || CASE WHEN page_id % 3 = 0 THEN '<a class="book-now" data-price>Booking</a>' ELSE '' END""")
    u = t.pages.select(c("page_id").alias("id"), "url", html.alias("html")).unionByName(
        inputs.raw(t).select((c("product_id") + 1000000).alias("id"), "url", F.lit("").alias("html")))
    return u.select("id", pages.page_type(c("url")).alias("page_type"), pages.is_product_page(c("url"), c("html")).alias("product_page"))


@query("flt10_search", f"""
WITH {inputs.CATALOG_SQL} SELECT catalog_id, name FROM catalog WHERE contains(lower(name), 'ring') OR contains(lower(city), 'ring')
 OR contains(lower(country), 'ring') OR contains(lower(category), 'ring')""")
def _(t):
    return reports.search(inputs.catalog(t), "RING", ["name", "city", "country", "category"]).select("catalog_id", "name")


@query("flt11_facets", f"""
WITH {inputs.SUPPLIERS_SQL} SELECT supplier_id, connection, run_id FROM suppliers WHERE connection IN ('API', 'BOTH') AND run_id IN ('run-0', 'run-1', 'run-2')""")
def _(t):
    return reports.facets(inputs.suppliers(t), connection=["API", "BOTH"], run_id=["run-0", "run-1", "run-2"], name=[]).select(
        "supplier_id", "connection", "run_id")


@query("flt12_country_contains", """SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE contains(lower(n_name), 'nation_1') OR contains('nation_1', lower(n_name)) OR contains(lower(n_name), 'nation_23x') OR contains('nation_23x', lower(n_name))""")
def _(t):
    rows = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey"))
    return reports.country_matches(rows, "n_name", ["Nation_1", "NATION_23x"]).select("c_custkey", "n_name")


@query("flt13_listing", f"""
WITH {inputs.CATALOG_SQL} SELECT catalog_id AS product_id, name, city, country, activity, coalesce(category, '') AS category,
 CAST(coalesce(trunc(price), 0) AS INTEGER) AS price, 0 AS duration FROM catalog WHERE activity = 'EXCURSION' AND city = 'Rome'""")
def _(t):
    rows = inputs.catalog(t).select(c("catalog_id").alias("product_id"), "name", "city", "country", "activity", "category", "price",
                                    F.lit(None).cast("int").alias("duration"))
    return reports.listing(rows, activity="EXCURSION", city="Rome")


_ = rules
