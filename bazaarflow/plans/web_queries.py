"""Queries: page tables, landed JSON, scans and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarflow import vocab
from bazaarflow.functions import pages, text
from bazaarflow.operators import expand, upsert, web
from bazaarflow.plans import inputs
from bazaarflow.plans.registry import query
from bazaarflow.plans.sqltext import any_of, case_equal, case_words, hits, in_list, quoted, values
from bazaarflow.plans.text_queries import _host, sql_drop_tags, sql_strip
from bazaarflow.session import scratch_path
from bazaarflow.sources import partitioned, places, readers, sinks

c = F.col

# Pages with supplier signals: the page text plus what its id decides.
_EXTRA = inputs.pick("page_id", "''", "'<a href=\"/tours/x\">Book Now</a> from $ 20 per person'", "'<script src=\"https://widgets.bokun.io\"></script>'",
                     "'see /api/v1 and swagger docs, powered by FareHarbor'", "'{\"addressCountry\": \"Italy\", \"addressLocality\": \"Rome\"}'")
_SITE = f"site AS (SELECT page_id, url, html || {_EXTRA} AS html FROM pages)"


def _site(t):
    return t.pages.selectExpr("page_id", "url", f"html || {_EXTRA} AS html")


def sql_score(low: str) -> str:
    p = vocab.SUPPLIER_POINTS
    any_points = lambda kws, k: f"CASE WHEN {any_of(low, kws)} THEN {p[k]} ELSE 0 END"
    return (f"least(100, {any_points([s for s, _ in vocab.CHANNEL_SIGNALS], 'channel')} + {any_points(vocab.API_SIGNALS, 'api')} + "
            f"{any_points(vocab.PRODUCT_SIGNALS, 'products')} + {any_points(vocab.CTA_SIGNALS, 'cta')} + {any_points(vocab.PRICE_SIGNALS, 'price')}")


_channel = lambda low: case_words(low, [([s], n) for s, n in vocab.CHANNEL_SIGNALS], "NULL")


@query("web1_supplier_signals", f"""
WITH {_SITE} SELECT page_id, {_channel('lower(html)')} AS channel, {any_of('lower(html)', vocab.API_SIGNALS)} AS has_api,
 {any_of('lower(html)', vocab.PRODUCT_SIGNALS)} AS has_products, {any_of('lower(html)', vocab.CTA_SIGNALS)} AS has_cta,
 {any_of('lower(html)', vocab.PRICE_SIGNALS)} AS has_price, {sql_score('lower(html)')} + 5 * {hits('lower(html)', ['rome', 'there'])}) AS score FROM site""")
def _(t):
    return _site(t).withColumn("_s", pages.supplier_signals(c("html"), ["rome", "there"])).select("page_id", "_s.*")


@query("web2_connection", f"""
WITH {_SITE}, x AS (SELECT page_id, {any_of('lower(html)', vocab.API_SIGNALS)} AS a, {_channel('lower(html)')} AS ch FROM site)
SELECT page_id, CASE WHEN a THEN 'API_DIRECT' END AS api_name, ch AS channel_name,
 CASE WHEN a AND ch IS NOT NULL THEN 'BOTH' WHEN a THEN 'API' WHEN ch IS NOT NULL THEN 'CHANNEL' ELSE 'NONE' END AS type FROM x""")
def _(t):
    return _site(t).withColumn("_l", pages.connection(c("html"))).select("page_id", "_l.api_name", "_l.channel_name", "_l.type")


@query("web3_embedded_geo", """
SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'Italy' END AS country, CASE WHEN page_id % 5 = 4 THEN 'Rome' ELSE 'Calle ' || CAST(page_id AS STRING) END AS city FROM pages""")
def _(t):
    g = pages.embedded_geo(c("html"), F.concat(F.lit("Calle "), c("page_id").cast("string"), F.lit(", Town")))
    return _site(t).withColumn("_g", g).select("page_id", "_g.country", "_g.city")


# Product pages with embedded data, written from the part table.
_LD_NAME = "p_name || ' Tour ' || CAST(p_partkey AS STRING)"
_LD = inputs.pick(
    "p_partkey",
    "'{\"@type\":\"Product\",\"name\":\"' || " + _LD_NAME + " || '\",\"description\":\"A ' || p_name || '\",\"offers\":{\"price\":' || CAST(p_size AS STRING) || ',\"priceCurrency\":\"EUR\"},\"location\":{\"addressLocality\":\"Rome\",\"addressCountry\":\"IT\"},\"url\":\"https://x.example/' || CAST(p_partkey AS STRING) || '\"}'",
    "'[{\"@type\":\"TouristTrip\",\"name\":\"' || " + _LD_NAME + " || '\",\"offers\":[{\"price\":\"' || CAST(p_size AS STRING) || '\",\"priceCurrency\":\"USD\"}]},{\"@type\":\"WebSite\",\"name\":\"site\"}]'",
    "'{\"@type\":\"Event\",\"description\":\"no name\"}'",
    "'{broken'")
_LD_HTML = "'<html><head><script type=\"application/ld+json\">' || " + _LD + " || '</script></head><body><h1>' || p_name || '</h1></body></html>'"


@query("web4_ld_products", f"""
SELECT p_partkey, {_LD_NAME} AS title, CASE WHEN p_partkey % 4 = 0 THEN 'A ' || p_name ELSE '' END AS description,
 CAST(p_size AS STRING) || CASE WHEN p_partkey % 4 = 0 THEN ' EUR' ELSE '' END AS price_raw,
 CASE WHEN p_partkey % 4 = 0 THEN 'Product' ELSE 'TouristTrip' END AS category, CASE WHEN p_partkey % 4 = 0 THEN 'Rome' ELSE '' END AS city,
 CASE WHEN p_partkey % 4 = 0 THEN 'https://x.example/' || CAST(p_partkey AS STRING) ELSE 'https://page.example/' END AS url,
 {case_words('lower(p_name)', vocab.HEURISTIC_ACTIVITY_RULES, 'EXCURSION')} AS activity FROM part WHERE p_partkey % 4 IN (0, 1)""")
def _(t):
    items = t.part.select("p_partkey", F.inline(pages.ld_products(F.expr(_LD_HTML), F.lit("https://page.example/"))))
    return items.select("p_partkey", "title", "description", "price_raw", "category", "city", "url", "activity")


_PRICED = "replace(html, '</h1>', CASE WHEN page_id % 2 = 0 THEN '</h1><span>From €' || CAST(page_id AS STRING) || '</span>' ELSE '</h1>' END)"
_BODY = f"({_PRICED})"
for _e in ("script", "style", "nav", "footer", "header", "aside", "form", "iframe"):
    _BODY = f"regexp_replace({_BODY}, '<{_e}\\b[^>]*>.*?</{_e}>', ' ', 'gis')"


def sql_decode(expr: str) -> str:
    for a, b in text.ENTITIES:
        expr = f"replace({expr}, {quoted(a)}, {quoted(b)})"
    return expr


@query("web5_heading_products", f"""
WITH b AS (SELECT page_id, {_BODY} AS html FROM pages), x AS (SELECT page_id, regexp_extract(html, '(?is)(<h[1-4][\\s>].*)', 1) AS piece FROM b),
y AS (SELECT page_id, {sql_strip("regexp_extract(piece, '(?is)^<h[1-4][^>]*>(.*?)</h[1-4]>', 1)")} AS title, trim(regexp_extract(piece, '>([^<>]*(?:[$€£¥]|USD|EUR|AED|DZD|TND)[^<>]*)<', 1)) AS price FROM x)
SELECT page_id, title, {sql_decode('price')} AS price_raw FROM y WHERE length(title) > 10 AND length(title) < 150""")
def _(t):
    return t.pages.select("page_id", F.inline(pages.heading_products(F.expr(_PRICED), words=())))


@query("web6_line_products", f"""
WITH x AS (SELECT doc_id, trim(unnest(string_split(replace(text, '.', chr(10)), chr(10)))) AS line FROM documents)
SELECT DISTINCT doc_id, line FROM x WHERE length(line) > 10 AND length(line) < 150 AND len(list_filter(string_split_regex(line, '\\s+'), lambda w: w <> '')) >= 3
 AND NOT starts_with(line, 'http') AND NOT regexp_full_match(line, '[\\d[^\\p{{L}}\\p{{N}}\\p{{M}}_]]+') AND {any_of('lower(line)', vocab.LINE_WORDS)}""")
def _(t):
    lines = pages.line_products(F.replace(c("text"), F.lit("."), F.lit("\n")))
    return t.documents.select("doc_id", F.explode(lines).alias("line"))


_XML = ("'<?xml version=\"1.0\"?><urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\"><url><loc>https://s.example/tours/' || replace(p_name, ' ', '-') || '-'"
        " || CAST(p_partkey AS STRING) || '/</loc></url><url><loc> https://s.example/about </loc></url></urlset>'")


@query("web7_sitemap", """
SELECT p_partkey, 'https://s.example/tours/' || replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS STRING) || '/' AS url,
 array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' ' || CAST(p_partkey AS STRING) AS title FROM part""")
def _(t):
    return t.part.select("p_partkey", F.inline(pages.sitemap_products(F.expr(_XML))))


@query("web8_same_site_links", r"""
WITH x AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) AS site, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages)
SELECT DISTINCT page_id, site || href AS link FROM x WHERE starts_with(href, '/')""")
def _(t):
    return t.pages.select("page_id", F.explode(pages.same_site_links(c("html"), c("url"))).alias("link"))


_OP = ("'<div class=\"card supplier-name\">' || p_brand || ' Travel</div><p>Supplied by Acme ' || p_name || ', Reviews 5</p><script type=\"application/ld+json\">{\"provider\":{\"name\":\"Org '"
       " || p_type || '\"}}</script><div class=\"provider\">Viator</div>'")


@query("web9_operator_names", """
SELECT p_partkey, p_brand || ' Travel' AS operator FROM part UNION ALL SELECT p_partkey, 'Acme ' || p_name FROM part UNION ALL SELECT p_partkey, 'Org ' || p_type FROM part""")
def _(t):
    return t.part.select("p_partkey", F.explode(pages.operator_names(F.expr(_OP))).alias("operator"))


_ITEM = "'{\"nom_produit\":\"' || p_name || ' city walk\",\"prix_raw_text\":\"' || CAST(p_size AS STRING) || ' €\",\"destination\":\"' || p_name || '\"}'"
_REPLY = inputs.pick("p_partkey", "'<think>hm {x}</think>```json{\"products\":[' || " + _ITEM + " || ',{\"nom_produit\":\"short\"}]}```'",
                     "'[' || " + _ITEM + " || ',{\"nom_produit\":\"A long enough title\",\"error\":true}]'", "'sorry, no products'", "'{\"products\": [{]'")


@query("web10_reply_items", """SELECT p_partkey, p_name || ' city walk' AS title, CAST(p_size AS STRING) || ' €' AS price_text FROM part WHERE p_partkey % 4 < 2""")
def _(t):
    items = t.part.select("p_partkey", F.inline(pages.reply_items(F.expr(_REPLY))))
    return items.select("p_partkey", c("nom_produit").alias("title"), c("prix_raw_text").alias("price_text"))


@query("web10_reply_place", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'City ' || event_type END AS city, CASE WHEN event_id % 2 = 0 THEN 'Italy' END AS country,
 CAST(round(least(1.0, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 50), 2) AS DOUBLE) AS confidence FROM events""")
def _(t):
    reply = F.expr("""'<think>{no}</think>Answer: ```json\n{"detected_city": "' || CASE WHEN event_id % 3 = 0 THEN 'None' ELSE 'City ' || event_type END || '", "detected_country": '
        || CASE WHEN event_id % 2 = 0 THEN '"Italy"' ELSE 'null' END || ', "confidence": ' || CAST(CAST(get_json_object(props, '$.k') AS DOUBLE) / 50 AS STRING) || '}```'""")
    return t.events.withColumn("_p", pages.reply_place(reply)).select("event_id", "_p.city", "_p.country", "_p.confidence")


_ITEMS = f"""items AS (SELECT p_partkey % 500 AS page_id, p_partkey AS pos, 'https://x.example/italy/' || CAST(p_partkey % 500 AS STRING) AS page_url,
 {inputs.pick('p_size', "p_name || ' city walk'", "'Overview'", "p_name || ' museum entry'", "'Book online today'")} AS title, 'With guide' AS description,
 {inputs.pick('p_size', "'ticket'", 'NULL', "'unknown'")} AS activity, {inputs.pick('p_size', 'p_name', "'Old Castle'", "'Nowhere town'", "'x'")} AS destination,
 {inputs.pick('p_partkey', "'nation_' || CAST(p_partkey % 25 AS STRING)", 'NULL', "'Atlantis'")} AS country, CAST(p_size AS STRING) || ' USD' AS price_text,
 CAST(NULL AS STRING) AS url, '2 hours' AS duration FROM part)"""


def _items(t):
    return t.part.selectExpr(
        "p_partkey % 500 AS page_id", "p_partkey AS pos", "'https://x.example/italy/' || CAST(p_partkey % 500 AS STRING) AS page_url",
        inputs.pick("p_size", "p_name || ' city walk'", "'Overview'", "p_name || ' museum entry'", "'Book online today'") + " AS title", "'With guide' AS description",
        inputs.pick("p_size", "'ticket'", "NULL", "'unknown'") + " AS activity", inputs.pick("p_size", "p_name", "'Old Castle'", "'Nowhere town'", "'x'") + " AS destination",
        inputs.pick("p_partkey", "'nation_' || CAST(p_partkey % 25 AS STRING)", "NULL", "'Atlantis'") + " AS country", "CAST(p_size AS STRING) || ' USD' AS price_text",
        "CAST(NULL AS STRING) AS url", "'2 hours' AS duration")


def sql_ground(source: str, destination: str, country: str) -> str:
    """CTE ``g``: the source with grounded_city and grounded_country (needs countries and cities)."""
    return f"""g0 AS (SELECT s.*, co.country AS gc FROM {source} s LEFT JOIN countries co ON length(trim(s.{country})) > 1 AND lower(trim(s.{country})) = lower(co.country)),
g AS (SELECT g0.*, gc AS grounded_country, CASE WHEN length(trim({destination})) > 2 AND NOT {any_of(f'lower(trim({destination}))', vocab.ATTRACTION_WORDS)}
 THEN coalesce(CASE WHEN gc IS NOT NULL THEN (SELECT arg_min(name, city_id) FROM cities x WHERE lower(x.name) = lower(trim(g0.{destination})) AND lower(x.country) = lower(gc))
  ELSE (SELECT arg_min(name, city_id) FROM cities x WHERE lower(x.name) = lower(trim(g0.{destination}))) END, trim({destination})) END AS grounded_city FROM g0)"""


@query("web11_validated_products", f"""
WITH {_ITEMS}, {inputs.CITIES_SQL}, {inputs.COUNTRIES_SQL},
ok AS (SELECT * FROM items WHERE length(title) >= 8 AND contains(title, ' ') AND NOT regexp_matches(lower(title), '^book\\s+') AND NOT {in_list('lower(title)', vocab.GARBAGE_TITLES)}),
f AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY page_id, title ORDER BY pos) = 1),
s AS (SELECT page_id, pos, title, destination, coalesce(nullif(trim(country), ''), 'Italy') AS country, CASE WHEN upper(activity) IN ('TICKET') THEN 'TICKET'
 ELSE {case_words("lower(title || ' ' || description)", vocab.EXTRACT_ACTIVITY_RULES, 'EXCURSION')} END AS activity,
 CASE WHEN CAST(regexp_extract(price_text, '([0-9]+)', 1) AS DOUBLE) BETWEEN 1 AND 5000 THEN CAST(regexp_extract(price_text, '([0-9]+)', 1) AS DOUBLE) END AS amount FROM f),
{sql_ground('s', 'destination', 'country')}
SELECT page_id, pos, title, activity, amount, 'USD' AS currency, grounded_city, grounded_country FROM g""")
def _(t):
    out = web.validated_products(_items(t), inputs.countries(t), inputs.cities(t))
    return out.select("page_id", "pos", "title", "activity", "amount", "currency", "grounded_city", "grounded_country")


@query("web12_country_of_path", f"""
WITH {inputs.RAW_SQL} SELECT product_id AS id, CASE WHEN contains(url, '/italy/') THEN 'Italy' END AS country FROM raw
UNION ALL SELECT page_id + 100000000, NULL FROM pages""")
def _(t):
    u = inputs.raw(t).select(c("product_id").alias("id"), "url").unionByName(t.pages.select((c("page_id") + 100000000).alias("id"), "url"))
    return u.select("id", pages.country_of_path(c("url")).alias("country"))


_PLACES = """places AS (SELECT page_id AS seq, CASE page_id % 5 WHEN 0 THEN 'City Bank Tours' WHEN 1 THEN 'Plain name' ELSE 'Sunny Tours ' || CAST(page_id AS STRING) END AS name,
 url, CASE WHEN page_id % 7 = 0 THEN 'we use rezdy' ELSE '' END AS description, 'Main Street, Town' AS address FROM pages)"""


@query("web13_qualified_leads", f"""
WITH {_SITE}, {_PLACES}, h AS (SELECT {_host} AS host, arg_min(html, page_id) AS html FROM site GROUP BY 1),
p AS (SELECT *, {_host} AS domain FROM places),
ok AS (SELECT * FROM p WHERE length(name) >= 3 AND NOT {any_of('lower(name)', vocab.NOT_SUPPLIER_WORDS)} AND length(domain) >= 5 AND NOT {any_of('domain', vocab.SKIP_DOMAINS)}
 AND {any_of("lower(name || ' ' || domain)", vocab.TRAVEL_WORDS)}),
w AS (SELECT ok.*, h.html, CASE WHEN h.html IS NULL THEN 0 ELSE {sql_score('lower(h.html)')}) END AS score,
 {any_of("lower(name || ' ' || description || ' ' || domain)", vocab.API_SIGNALS)} AS has_api, {_channel("lower(name || ' ' || description || ' ' || domain)")} AS channel_name
 FROM ok LEFT JOIN h ON domain = h.host),
z AS (SELECT *, channel_name IS NOT NULL OR score >= 50 AS has_channel FROM w)
SELECT domain, seq, name, score, channel_name, CASE WHEN has_api AND has_channel THEN 'BOTH' WHEN has_api THEN 'API' ELSE 'CHANNEL' END AS connection
FROM z WHERE has_api OR has_channel QUALIFY row_number() OVER (PARTITION BY domain ORDER BY seq) = 1""")
def _(t):
    by_host = _site(t).withColumn("host", text.host(c("url"))).groupBy("host").agg(F.min_by("html", "page_id").alias("html"))
    rows = t.pages.selectExpr(
        "page_id AS seq", "CASE page_id % 5 WHEN 0 THEN 'City Bank Tours' WHEN 1 THEN 'Plain name' ELSE 'Sunny Tours ' || CAST(page_id AS STRING) END AS name",
        "url", "CASE WHEN page_id % 7 = 0 THEN 'we use rezdy' ELSE '' END AS description", "'Main Street, Town' AS address")
    return web.qualify_leads(rows, by_host).select("domain", "seq", "name", "score", "channel_name", "connection")


@query("web14_result_rows", f"""
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'error' WHEN p_partkey % 4 < 2 THEN 'ok' ELSE 'no_products' END AS status,
 CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 4 < 2 THEN {_LD_NAME} END AS title,
 CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 4 = 0 THEN 'Rome' WHEN p_partkey % 7 = 0 AND p_partkey % 4 = 0 THEN 'Rome' ELSE 'Oslo' END AS city,
 CASE WHEN p_partkey % 4 = 0 THEN 'IT' ELSE 'Norway' END AS country FROM part""")
def _(t):
    x = t.part.select("p_partkey", pages.ld_products(F.expr(_LD_HTML), F.lit("https://page.example/")).alias("items"),
                      F.when(c("p_partkey") % 7 == 0, "timeout").alias("error"), F.lit("Oslo").alias("page_city"), F.lit("Norway").alias("page_country"))
    return web.result_rows(x, keys=["p_partkey"]).select("p_partkey", "status", "title", "city", "country")


# --- scans and landed JSON --------------------------------------------------------------------
@query("src1_catalogue_scan", "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part WHERE p_size >= 25")
def _(t):
    return readers.read_table(t.spark, f"{t.folder}/part.parquet", ["p_partkey", "p_name", "p_brand", "p_retailprice"], c("p_size") >= 25)


@query("src2_supplier_reads", f"""
WITH {inputs.SUPPLIERS_SQL} SELECT supplier_id, name, score, connection FROM suppliers JOIN nation ON country_id = n_nationkey
WHERE (has_api OR has_channel) AND contains(lower(n_name), 'nation_1') AND run_id = 'run-1' ORDER BY score DESC, supplier_id""")
def _(t):
    wanted = t.nation.select(c("n_nationkey").alias("country_id"), c("n_name").alias("country"))
    rows = readers.suppliers_of_countries(readers.supplier_rows(inputs.suppliers(t), run_id="run-1", connectable=True), wanted, "Nation_1")
    return rows.select("supplier_id", "name", "score", "connection").orderBy(F.desc("score"), "supplier_id")


@query("src3_country_dimension", "SELECT n_nationkey AS country_id, n_name AS country, r_name AS zone, n_regionkey AS zone_id FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    return inputs.countries(t).join(t.region, c("zone_id") == c("r_regionkey")).select("country_id", "country", c("r_name").alias("zone"), "zone_id")


@query("src4_city_gazetteer", "SELECT s_suppkey AS city_id, s_name AS name, n_name AS country, s_acctbal AS lat FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    path = scratch_path(t.spark, "cities-json")
    t.supplier.select(c("s_suppkey").alias("id"), c("s_name").alias("name"), c("s_nationkey").alias("country_id"), c("s_acctbal").alias("latitude")).write.json(path)
    return readers.read_cities(t.spark, path, inputs.countries(t), multi_line=False).select("city_id", "name", "country", "lat")


@query("src5_lead_csv", """
SELECT p_name || ', "the best"' AS company, 'https://x.example/' || CAST(p_partkey AS STRING) AS website, 'line one' || chr(10) || 'line, two' AS snippet,
 'api' AS matched_keyword, lower(p_type) AS query FROM part""")
def _(t):
    path = scratch_path(t.spark, "leads-csv")
    rows = t.part.select(F.concat("p_name", F.lit(', "the best"')).alias("company"), F.concat(F.lit("https://x.example/"), c("p_partkey").cast("string")).alias("website"),
                         F.lit("line one\nline, two").alias("snippet"), F.lit("api").alias("matched_keyword"), F.concat(F.lower("p_type"), F.lit(" ")).alias("query"))
    sinks.write_csv(rows, path, ["company", "website", "snippet", "matched_keyword", "query"])
    return readers.read_leads(t.spark, path)


_CATEGORY = inputs.pick("s_suppkey", "'Tour operator'", "'Software company'", "'Museum'", "''")
_WEB = inputs.pick("s_suppkey", "'https://www.shop' || CAST(s_suppkey AS STRING) || '.example/a'", "''", "'http://facebook.com/x'",
                   "'tours' || CAST(s_suppkey AS STRING) || '.example'", "'https://m.shop.example?x=1'")
_WEB_HOST = inputs.pick("s_suppkey", "'shop' || CAST(s_suppkey AS STRING) || '.example'", "''", "'facebook.com'", "'tours' || CAST(s_suppkey AS STRING) || '.example'", "'m.shop.example'")


@query("src6_places", f"""
WITH x AS (SELECT s_suppkey, s_name, {_CATEGORY} AS category, {_WEB_HOST} AS domain, CAST(s_suppkey % 5 AS DOUBLE) AS rating FROM supplier),
ok AS (SELECT * FROM x WHERE NOT {any_of('lower(category)', vocab.SKIP_CATEGORIES)} AND length(domain) >= 4 AND NOT {any_of('domain', vocab.SEARCH_SKIP_DOMAINS)})
SELECT s_suppkey, s_name AS name, domain, 'Street 1' AS address, '+39 1' AS phone, rating, 12 AS reviews, 'maps' AS source FROM ok
UNION ALL SELECT s_suppkey, s_name, domain, 'Road 2', '', rating, 0, 'local' FROM ok""")
def _(t):
    maps = F.expr(f"""'{{"name":"' || s_name || '","website":"' || {_WEB} || '","type":"' || {_CATEGORY} || '","full_address":"Street 1","phone_numbers":["+39 1"],"rating":' || CAST(s_suppkey % 5 AS STRING) || ',"review_count":12}}'""")
    local = F.expr(f"""'{{"title":"' || s_name || '","website":"' || {_WEB} || '","category":"' || {_CATEGORY} || '","address":"Road 2","rating":"' || CAST(s_suppkey % 5 AS STRING) || '"}}'""")
    out = places.all_places(t.supplier.select("s_suppkey", maps.alias("j")), t.supplier.select("s_suppkey", local.alias("j")), "j")
    return out.select("s_suppkey", "name", "domain", "address", "phone", "rating", "reviews", "source")


@query("src7_city_names", """
WITH x AS (SELECT c_nationkey, c_mktsegment || ' town' AS city FROM customer UNION ALL SELECT c_nationkey, upper(c_mktsegment) || ' town' FROM customer UNION ALL SELECT c_nationkey, 'Place' FROM customer)
SELECT c_nationkey, min(city) AS city FROM x GROUP BY c_nationkey, lower(city)""")
def _(t):
    j = F.expr("""'[{"name":"z","address":{"town":"' || c_mktsegment || ' town"}},{"address":{"city":"' || upper(c_mktsegment) || ' town"}},{"name":"City in x"},{"name":" Place "},{"name":"","address":{"suburb":"q"}}]'""")
    return places.city_names(t.customer.select("c_nationkey", j.alias("j")), "j", ["c_nationkey"])


@query("src8_search_results", f"""
WITH x AS (SELECT page_id, url, {_host} AS domain FROM pages)
SELECT page_id, 'Result ' || CAST(page_id AS STRING) AS title, url AS link, 'text' AS snippet, domain FROM x WHERE NOT {any_of('domain', vocab.SEARCH_SKIP_DOMAINS)}""")
def _(t):
    j = F.expr("""'{"' || CASE page_id % 3 WHEN 0 THEN 'organic_results' WHEN 1 THEN 'results' ELSE 'items' END || '":[{"title":" Result ' || CAST(page_id AS STRING) || '","link":"' || url
        || '","snippet":"text"},{"title":"x","link":"https://www.youtube.com/v"},{"title":"","link":"https://y.example"}]}'""")
    return places.search_results(t.pages.select("page_id", j.alias("j")), "j", ["page_id"])


# --- sinks ------------------------------------------------------------------------------------
@query("snk1_upsert", """
WITH d AS (SELECT p_partkey * 2 AS id, upper(p_name) AS name, p_retailprice + 1 AS price FROM part)
SELECT * FROM d UNION ALL SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_partkey NOT IN (SELECT id FROM d)""")
def _(t):
    base = t.part.select(c("p_partkey").alias("id"), c("p_name").alias("name"), c("p_retailprice").alias("price"))
    delta = t.part.select((c("p_partkey") * 2).alias("id"), F.upper("p_name").alias("name"), (c("p_retailprice") + 1).alias("price"))
    return upsert.upsert(base, delta, ["id"])


@query("snk1_touched_upsert", """
WITH d AS (SELECT p_partkey * 2 AS id, arg_max(upper(p_name), p_size) AS name, arg_max(p_retailprice + 1, p_size) AS price FROM part WHERE p_partkey <= 40 GROUP BY p_partkey)
SELECT id, name, price, true AS stamped FROM d UNION ALL SELECT p_partkey, p_name, p_retailprice, false FROM part WHERE p_partkey NOT IN (SELECT id FROM d)""")
def _(t):
    # A table in partitions, of which a small delta rewrites those it touches.
    path = scratch_path(t.spark, "keyed")
    base = t.part.select(c("p_partkey").alias("id"), c("p_name").alias("name"), c("p_retailprice").alias("price"), F.lit(None).cast("timestamp").alias("at"))
    partitioned.create_table(base, path, ["id"], parts=16)
    delta = t.part.where("p_partkey <= 40").select((c("p_partkey") * 2).alias("id"), F.upper("p_name").alias("name"), (c("p_retailprice") + 1).alias("price"), "p_size")
    partitioned.upsert_table(path, delta, ["id"], stamp="at", order="p_size")
    return partitioned.read_table(t.spark, path).select("id", "name", "price", c("at").isNotNull().alias("stamped"))


@query("snk2_insert_absent", """
SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT c_custkey * 3, 'new' FROM customer WHERE c_custkey * 3 NOT IN (SELECT c_custkey FROM customer)""")
def _(t):
    base = t.customer.select(c("c_custkey").alias("id"), c("c_name").alias("name"))
    return upsert.insert_absent(base, t.customer.select((c("c_custkey") * 3).alias("id"), F.lit("new").alias("name")), ["id"])


@query("snk3_rebuild_or_merge", """
SELECT 'rebuild' AS mode, c_custkey AS id, c_acctbal AS v FROM customer
UNION ALL SELECT 'merge', c_custkey * 2, c_acctbal * 10 FROM customer
UNION ALL SELECT 'merge', c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey * 2 FROM customer)""")
def _(t):
    path = scratch_path(t.spark, "customers")
    cur = t.customer.select(c("c_custkey").alias("id"), c("c_acctbal").alias("v"))
    fresh = t.customer.select((c("c_custkey") * 2).alias("id"), (c("c_acctbal") * 10).alias("v"))
    sinks.write_table(fresh, path)
    sinks.write_table(sinks.rebuild_or_merge(fresh, cur, ["id"], rebuild=True), path)
    rebuilt = readers.read_table(t.spark, path)
    merged = sinks.rebuild_or_merge(rebuilt, fresh, ["id"], rebuild=False)
    return rebuilt.withColumn("mode", F.lit("rebuild")).unionByName(merged.withColumn("mode", F.lit("merge")))


@query("snk4_append_results", """
SELECT event_type AS tool, count(*) AS n, CAST(sum(CAST(value IS NOT NULL AS INTEGER)) AS BIGINT) AS given FROM (SELECT * FROM events UNION ALL SELECT * FROM events) GROUP BY event_type""")
def _(t):
    path = scratch_path(t.spark, "results")
    rows = t.events.select(c("event_type").alias("tool"), "value")
    sinks.write_table(rows, path, mode="append", partition_by=["tool"])
    sinks.write_table(rows, path, mode="append", partition_by=["tool"])
    return readers.read_table(t.spark, path).groupBy("tool").agg(F.count("*").alias("n"), F.count("value").alias("given"))


@query("snk5_csv_export", f"WITH {inputs.SUPPLIERS_SQL} SELECT CAST(supplier_id AS STRING) AS supplier_id, name, domain, connection FROM suppliers")
def _(t):
    path = scratch_path(t.spark, "suppliers-csv")
    sinks.write_csv(inputs.suppliers(t), path, ["supplier_id", "name", "domain", "connection", "not_there"])
    return t.spark.read.option("header", True).csv(path)


@query("snk6_product_export", f"""
WITH {inputs.RAW_SQL} SELECT product_id, title AS name, 'service' AS type, coalesce(price, 0) AS list_price, nullif({sql_drop_tags('description')}, '') AS description,
 CASE WHEN category_raw = 'promo' THEN 'TICKET' ELSE 'EXCURSION' END AS activity, nullif(country_raw, '') AS country,
 coalesce({case_equal('source', vocab.SOURCE_METHODS)}, 'playwright') AS method, 0.0::DOUBLE AS similarity, true AS sale_ok FROM raw""")
def _(t):
    r = inputs.raw(t).select("product_id", "title", "price", "description", c("city_raw").alias("city"), c("country_raw").alias("country"),
                             F.when(c("category_raw") == "promo", "TICKET").otherwise(c("category_raw")).alias("activity"), c("category_raw").alias("category"),
                             F.lit(None).cast("int").alias("duration_minutes"), F.lit(None).cast("boolean").alias("price_is_estimated"), "url", "source", "run_id",
                             F.lit(None).cast("double").alias("similarity"), F.lit("s").alias("supplier_name"), F.lit("d").alias("supplier_domain"))
    return sinks.product_export(r).select(
        "product_id", "name", "type", "list_price", "description", "activity", "country", "method", "similarity", "sale_ok")


_EX_COUNTRY = inputs.pick("supplier_id", "'Italy'", "'Japan'", "'Peru'", "'Atlantis'", "NULL")


@query("snk7_supplier_export", f"""
WITH {inputs.SUPPLIERS_SQL}, {values('zones', 'country, zone', vocab.EXPORT_ZONES)}, x AS (SELECT *, {_EX_COUNTRY} AS country FROM suppliers)
SELECT supplier_id, name, 'https://' || domain AS website, score, has_api, connection, coalesce(zone, '2') AS zone, 0 AS products_scraped FROM x LEFT JOIN zones USING (country)""")
def _(t):
    x = inputs.suppliers(t).selectExpr("*", f"{_EX_COUNTRY} AS country", "CAST(NULL AS INT) AS scraped", "CAST(NULL AS INT) AS accepted")
    x = x.withColumn("connection", F.lower("connection"))
    return sinks.supplier_export(x).select("supplier_id", "name", "website", "score", "has_api", "connection", "zone", "products_scraped")


@query("jn19_country_queries", """
WITH q AS (SELECT n_name, unnest(['tour operator {country}', 'tour guide company {country}', 'museum tickets {country} online']) AS q FROM nation
UNION ALL SELECT n_name, unnest(['tour operator {country} klook partner', 'tour operator {country}']) FROM nation WHERE lower(n_name) IN ('nation_3', 'nation_7'))
SELECT DISTINCT n_name, replace(q, '{country}', n_name) AS query FROM q""")
def _(t):
    return expand.country_queries(t.nation.select("n_name"), "n_name", ["tour operator {country}", "tour guide company {country}", "museum tickets {country} online"],
                                  [(["nation_3", "nation_7"], ["tour operator {country} klook partner", "tour operator {country}"])])


@query("jn20_marketplace_suppliers", """
WITH cities AS (SELECT n_name AS country, s_name AS city, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1 AS pos FROM supplier JOIN nation ON s_nationkey = n_nationkey),
first AS (SELECT * FROM cities ORDER BY country, pos LIMIT 1)
SELECT 'www.viator.com' AS domain, 'viator' AS marketplace, city FROM first WHERE false UNION ALL SELECT 'viator.com', 'viator', city FROM first UNION ALL SELECT 'klook.com', 'klook', city FROM first""")
def _(t):
    cities = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).groupBy("n_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"]).alias("l"))
    required = cities.select(F.create_map("n_name", "l").alias("cities"))
    known = t.region.select(F.when(c("r_regionkey") >= 0, "getyourguide.com").alias("domain")).distinct()
    return expand.marketplace_suppliers(required, "cities", known).select("domain", "marketplace", "city")


_ = quoted
