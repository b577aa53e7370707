"""Catalogue stages bound to the test tables, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarflow import vocab
from bazaarflow.plans import catalogue, inputs
from bazaarflow.plans.inputs import derive, pick, select
from bazaarflow.plans.registry import query
from bazaarflow.plans.sqltext import any_of, case_equal, case_words, hits, in_list, quoted
from bazaarflow.plans.text_queries import _marketing, sql_drop_tags, sql_replace, sql_signature, sql_squeeze

c = F.col
N = "p_partkey"
PRODUCTS = [
    ("product_id", N), ("name", pick(N, "' Rome Airport Transfer ' || p_name", "p_name || ' tour'", "NULL", "''", "'Le Musée de ' || p_name")),
    ("name_en", pick("p_size", "'The ' || p_name || ' Tour '", "NULL", "''")),
    ("description", pick(N, "'<p>A ' || p_name || ' visit</p>  with guide'", "NULL", "'<br/>'", "lower(p_type)")),
    ("type_code", pick("p_size", "'424'", "' 429 '", "'449'", "NULL", "'999'", "'429'")),
    ("price", f"CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 9 = 1 THEN 0.0 ELSE {inputs.PRICE} END"),
    ("currency_code", pick(N, "'403'", "'404'", "' 405'", "NULL", "'1'", "'407'")),
    ("active", pick("p_size", "1", "0", "NULL")), ("sellable", pick(N, "0", "1")),
    ("city_id", pick("p_size", f"CAST({N} % 40 AS INT)", "NULL", f"CAST({N} % 40 AS INT)", "0", f"CAST({N} % 25 AS INT)")),
    ("departure_id", f"CAST({N} % 31 AS INT)"), ("arrival_id", f"CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST({N} % 27 AS INT) END"),
    ("supplier_id", f"{N} % 10"), ("operator", pick("p_size", "'Operator ' || p_brand", "NULL", "''")),
    ("hours", pick(N, "2", "NULL", "0")), ("minutes", pick("p_size", "30", "NULL", "0")),
    ("promo", pick(N, "1", "0", "NULL")), ("private", pick("p_size", "0", "1")), ("b2c", pick(N, "NULL", "1", "0", "1")),
    ("address", pick(N, "'Italie - Rome'", "'Égypte – Le Caire'", "NULL", "'maroc'", "' Grèce - Athènes '", "''", "'Paris, France'")),
    ("product_type", pick("p_size", "' day trip '", "NULL", "''")), ("category", pick(N, "'CULTURAL'", "''", "NULL", "'NATURE '")),
    ("external_id", pick("p_size", "p_partkey + 9000000", "NULL", "CAST(0 AS BIGINT)"))]
LOCALITIES = [
    ("locality_id", "n_nationkey"), ("name", pick("n_nationkey", "' Moscou '", "n_name", "NULL", "'Tunis'")),
    ("name_en", pick("n_regionkey", "NULL", "''", "n_name || ' City '")),
    ("lat", "CASE WHEN n_nationkey % 6 = 0 THEN NULL WHEN n_nationkey % 6 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(n_nationkey + 1 AS DOUBLE) END"),
    ("lng", "CAST(n_regionkey + 1 AS DOUBLE)")]
DETAILS = [("product_id", "l_partkey"), ("language_id", "CASE WHEN l_linenumber % 2 = 0 THEN 44 ELSE l_linenumber END"),
           ("text", "'<b>text ' || CAST(l_orderkey AS STRING) || '</b>'")]
THEMES = [("product_id", "l_partkey"), ("theme_id", "CAST(l_suppkey % 7 AS INT)")]
LANGUAGES = [("product_id", "l_partkey"), ("language", pick("l_orderkey", "'fr'", "''", "NULL", "'en'", "'de'"))]


def _exonyms(value: str, pairs, otherwise: str) -> str:
    return f"({case_equal(f'lower(trim({value}))', pairs, otherwise)})"


def _initcap(value: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({value}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


_TAGS = sql_drop_tags("coalesce(description, '')")
_FLAG = lambda name: f"coalesce({name} = 1, false)"


@query("cls12_rebuild", f"""
WITH p AS (SELECT {select(PRODUCTS)} FROM part), loc AS (SELECT {select(LOCALITIES)} FROM nation), d AS (SELECT {select(DETAILS)} FROM lineitem),
own AS (SELECT product_id, max(text) AS detail FROM d WHERE language_id = 44 GROUP BY product_id),
th AS (SELECT product_id, list_sort(list(DISTINCT theme_id)) AS themes FROM (SELECT {select(THEMES)} FROM lineitem) GROUP BY product_id),
la AS (SELECT product_id, list_sort(list(DISTINCT language)) AS languages FROM (SELECT {select(LANGUAGES)} FROM lineitem) WHERE language <> '' GROUP BY product_id),
j AS (SELECT p.*, coalesce(detail, '') AS detail, coalesce(themes, []) AS themes, coalesce(languages, []) AS languages, a.locality_id AS found, a.lat, a.lng,
 coalesce(nullif(trim(coalesce(a.name_en, '')), ''), trim(coalesce(a.name, ''))) AS stop_city,
 coalesce(nullif(trim(coalesce(f.name_en, '')), ''), trim(coalesce(f.name, ''))) AS stop_from, coalesce(nullif(trim(coalesce(t.name_en, '')), ''), trim(coalesce(t.name, ''))) AS stop_to,
 trim(coalesce(p.address, '')) AS ad FROM p LEFT JOIN own USING (product_id) LEFT JOIN th USING (product_id) LEFT JOIN la USING (product_id)
 LEFT JOIN loc a ON a.locality_id = p.city_id LEFT JOIN loc f ON f.locality_id = p.departure_id LEFT JOIN loc t ON t.locality_id = p.arrival_id),
x AS (SELECT *, trim(coalesce(name, '')) AS title, trim(coalesce(name_en, '')) AS title_e, {case_equal('trim(type_code)', vocab.ACTIVITY_CODES, "'EXCURSION'")} AS activity,
 CASE WHEN {_TAGS} = '' THEN {sql_drop_tags('detail')} ELSE {_TAGS} END AS body, regexp_matches(ad, '[-–]') AS two,
 trim(regexp_replace(ad, '^(.*?)\\s*[-–]\\s*(.*)$', '\\2')) AS ad_city, trim(regexp_replace(ad, '^(.*?)\\s*[-–]\\s*(.*)$', '\\1')) AS ad_country FROM j),
y AS (SELECT *, CASE WHEN activity = 'TRANSFER' THEN stop_from ELSE '' END AS o, CASE WHEN activity = 'TRANSFER' THEN stop_to ELSE '' END AS t,
 coalesce(nullif(stop_city, ''), CASE WHEN two THEN ad_city ELSE '' END) AS c0, CASE WHEN two THEN ad_country ELSE ad END AS n0,
 city_id IS NOT NULL AND city_id <> 0 AS has_city FROM x),
z AS (SELECT *, coalesce({_exonyms('c0', vocab.CITY_EXONYMS, 'trim(c0)')}, '') AS city, CASE WHEN n0 = '' THEN '' ELSE {_exonyms('n0', vocab.COUNTRY_EXONYMS, _initcap('n0'))} END AS country,
 CASE WHEN has_city AND found IS NOT NULL THEN CASE WHEN coalesce(lat <> 0 AND lng <> 0, false) THEN 0.9 ELSE 0.5 END WHEN NOT has_city AND two AND ad_city <> '' THEN 0.3 ELSE 0.0 END AS conf FROM y),
k AS (SELECT *, {sql_signature('city', 'activity', "coalesce(nullif(title_e, ''), title)", vocab.CATALOG_SIGNATURE_STOP)} AS sk FROM z)
SELECT product_id, nullif(title, '') AS title, nullif(title_e, '') AS title_en, nullif(body, '') AS description, nullif(city, '') AS city, nullif(country, '') AS country,
 CASE WHEN has_city THEN lat END AS lat, CASE WHEN has_city THEN lng END AS lng, CAST(conf AS DOUBLE) AS city_confidence, activity,
 {case_equal('activity', vocab.SERVICE_CODES, "'TOUR'")} AS service, nullif(trim(coalesce(category, '')), '') AS category, nullif(trim(coalesce(product_type, '')), '') AS product_type,
 nullif(o, '') AS origin, nullif(t, '') AS destination, CASE WHEN o <> '' OR t <> '' THEN o || ' → ' || t END AS route_signature, nullif(CAST(price AS DOUBLE), 0) AS price,
 {case_equal('trim(currency_code)', vocab.CURRENCY_CODES, "'EUR'")} AS currency, {_FLAG('promo')} AS is_promo, nullif(coalesce(hours, 0) * 60 + coalesce(minutes, 0), 0) AS duration_minutes,
 {_FLAG('active')} AS is_active, {_FLAG('sellable')} AS is_sellable, nullif(coalesce("operator", ''), '') AS supplier_name, supplier_id, nullif(external_id, 0) AS external_id,
 {_FLAG('private')} AS is_private, {_FLAG('b2c')} AS is_b2c, array_to_string(themes, ',') AS themes, array_to_string(languages, ',') AS languages,
 sk || '_' || substr(md5(sk), 1, 16) AS matching_signature,
 concat_ws(' | ', coalesce(nullif(title_e, ''), nullif(title, '')), nullif(trim(city || ' ' || country), ''), activity, nullif(trim(coalesce(category, '')), ''), nullif(body, '')) AS embedding_text,
 CAST(conf AS DOUBLE) AS confidence FROM k""")
def _(t):
    out = catalogue.rebuild(derive(t.part, PRODUCTS), derive(t.nation, LOCALITIES), derive(t.lineitem, DETAILS), derive(t.lineitem, THEMES),
                            derive(t.lineitem, LANGUAGES))
    tags = c("activity_tags")
    return out.withColumn("is_private", tags["is_private"]).withColumn("is_b2c", tags["is_b2c"]) \
        .withColumn("themes", F.array_join(tags["themes"], ",")).withColumn("languages", F.array_join(tags["languages"], ",")).drop("activity_tags")


# --- the stage on flattened rows --------------------------------------------------------------
STAGE = [
    ("product_id", N), ("title", pick(N, "'<b>Airport</b> shuttle ' || p_name", "p_name || ' food tour'", "NULL", "''", "'Museum pass ' || p_name", "'Guided group walk'")),
    ("title_fr", pick("p_size", "'Visite privée ' || p_name", "''", "NULL")), ("description", pick("p_size", "'Skip the line &  lunch'", "NULL", "'<i>shared</i> taxi'")),
    ("type_code", pick("p_size", "'449'", "NULL", "'3'", "'Billet simple'", "'424'", "'Transport'", "'4'")),
    ("product_type", pick(N, "NULL", "'Type A'", "''")), ("category", pick("p_size", "''", "'CULTURAL'", "NULL")), ("subcategory", pick(N, "'sub'", "NULL")),
    ("product_group", pick("p_size", "NULL", "'group ' || p_brand")), ("kind", pick(N, "NULL", "''", "'excursions'", "NULL")),
    ("price", f"CASE WHEN p_size % 9 = 0 THEN NULL ELSE {inputs.PRICE} END"), ("currency", pick(N, "'EUR'", "''", "NULL", "'USD'")),
    ("address", pick(N, "'Italie - Rome'", "'Paris, France'", "NULL", "' Maroc '", "''")), ("operator", pick("p_size", "'Op ' || p_brand", "NULL")),
    ("supplier_id", f"{N} % 10"), ("active", pick("p_size", "1", "0", "NULL")), ("sellable", pick(N, "1", "NULL", "0")),
    ("city_id", f"CAST({N} % 33 AS INT)")]
STAGE_LOCALITIES = [
    ("locality_id", "n_nationkey"), ("name", pick("n_nationkey", "'Rome'", "n_name", "NULL", "'Tunis'", "''")), ("name_en", pick("n_regionkey", "NULL", "'Oslo'", "NULL")),
    ("iso", pick("n_nationkey", "' FR '", "NULL", "'it'", "'zz'", "''")), ("lat", pick("n_nationkey", "'41.9'", "'north'", "NULL", "'-3'")),
    ("lng", pick("n_regionkey", "'12.'", "'1e3'", "'7'"))]
STAGE_DETAILS = [("product_id", "l_partkey + 3"), ("language_id", "l_linenumber"), ("title", pick("l_orderkey", "NULL", "'Detail ' || CAST(l_orderkey AS STRING)")),
                 ("text", pick("l_orderkey", "'<p>Wine text ' || CAST(l_suppkey AS STRING) || '</p>'", "NULL", "'plain'"))]
STAGE_LINKS = [("product_id", "l_partkey + 1"), ("theme_id", "CAST(l_suppkey % 7 AS INT)")]
STAGE_THEMES = [("theme_id", "n_nationkey"), ("theme", pick("n_nationkey", "'culture'", "'food'", "NULL", "'walking ' || n_name"))]


def _pref(column: str) -> str:
    return (f"coalesce(max(CASE WHEN language_id = 2 THEN {column} END), max(CASE WHEN language_id = 1 THEN {column} END), max({column}), '')")


_named = "coalesce(nullif(detail_title, ''), nullif(title, ''), nullif(title_fr, ''))"
_service = (f"CASE WHEN {any_of('code', vocab.CATALOG_TICKET_CODES)} THEN 'TICKET' WHEN {in_list('code', vocab.CATALOG_TRANSFER_CODES)} OR "
            f"{any_of('code', vocab.CATALOG_TRANSFER_WORDS)} THEN 'TRANSFER' ELSE {case_words('low', vocab.CATALOG_SERVICE_RULES, 'TOUR')} END")
_tag_list = ", ".join(f"CASE WHEN contains(low, {quoted(w)}) THEN {quoted(w)} END" for w in sorted(vocab.CATALOG_TAG_WORDS))
_shown = ", ".join(f"CASE WHEN is_{f} THEN {quoted(f)} END" for f in vocab.SHOWN_FLAGS)
_COMPACT = "array_to_string(list_filter([{0}], lambda x: x IS NOT NULL), ',')"


@query("cls12_catalogue", f"""
WITH {inputs.CITIES_SQL}, p AS (SELECT {select(STAGE)} FROM part), loc AS (SELECT {select(STAGE_LOCALITIES)} FROM nation),
det AS (SELECT product_id, {_pref('title')} AS detail_title, {_pref('text')} AS detail_text FROM (SELECT {select(STAGE_DETAILS)} FROM lineitem) GROUP BY product_id),
nm AS (SELECT product_id, string_agg(DISTINCT theme, ' | ' ORDER BY theme) AS themes FROM (SELECT {select(STAGE_LINKS)} FROM lineitem) JOIN (SELECT {select(STAGE_THEMES)} FROM nation) USING (theme_id) GROUP BY product_id),
ci AS (SELECT lower(trim(name)) AS key, arg_min(country, city_id) AS found FROM cities GROUP BY 1),
j AS (SELECT p.*, coalesce(detail_title, '') AS detail_title, coalesce(detail_text, '') AS detail_text, themes, trim(coalesce(l.name_en, l.name, '')) AS c0, lower(trim(coalesce(l.iso, ''))) AS country_iso,
 CASE WHEN regexp_full_match(l.lat, '-?[0-9]+\\.?[0-9]*') THEN CAST(l.lat AS DOUBLE) END AS lat, CASE WHEN regexp_full_match(l.lng, '-?[0-9]+\\.?[0-9]*') THEN CAST(l.lng AS DOUBLE) END AS lng, trim(coalesce(address, '')) AS ad, lower(coalesce(type_code, '')) AS code
 FROM p LEFT JOIN loc l ON l.locality_id = p.city_id LEFT JOIN det USING (product_id) LEFT JOIN nm USING (product_id)),
a AS (SELECT *, CASE WHEN {_named} IS NULL THEN 'Product #' || CAST(product_id AS STRING) ELSE {sql_drop_tags(_named)} END AS clean_title,
 {sql_drop_tags("coalesce(nullif(detail_text, ''), description, '')")} AS clean_description, coalesce({case_equal('country_iso', vocab.ISO_COUNTRIES)}, '') AS n0 FROM j),
b AS (SELECT *, coalesce(nullif(c0, ''), CASE WHEN contains(ad, ' - ') THEN trim(ad[instr(ad, ' - ') + 3:]) WHEN contains(ad, ',') THEN trim(split_part(ad, ',', 1)) END, '') AS c1,
 coalesce(nullif(n0, ''), CASE WHEN contains(ad, ' - ') THEN trim(split_part(ad, ' - ', 1)) WHEN contains(ad, ',') THEN trim(ad[instr(ad, ',') + 1:]) END, '') AS n1 FROM a),
d AS (SELECT b.*, CASE WHEN n1 = '' AND c1 <> '' THEN coalesce({case_equal('lower(trim(c1))', vocab.CITY_COUNTRIES)}, found, '') ELSE n1 END AS country FROM b LEFT JOIN ci ON ci.key = nullif(lower(trim(c1)), '')),
e AS (SELECT *, CASE WHEN country <> '' AND c1 = '' AND ad <> '' THEN CASE WHEN contains(ad, ',') THEN trim(split_part(ad, ',', 1)) ELSE ad END ELSE c1 END AS city,
 lower(clean_title || ' ' || clean_description || ' ' || coalesce(themes, '')) AS low FROM d),
f AS (SELECT *, {_service} AS service, {case_words('low', [([w], w.upper()) for w in vocab.CATALOG_AIRPORT_WORDS], '')} AS origin, {case_words('low', vocab.CATALOG_FAMILY_RULES, 'TOURS_SIGHTSEEING')} AS family,
 {', '.join(f'{any_of("low", kws)} AS {l}' for l, kws in vocab.CATALOG_FLAG_WORDS)}, coalesce(CAST(price AS DOUBLE), 0) AS pr, coalesce("operator", '') AS supplier_name FROM e)
SELECT product_id, clean_title, clean_description, city, country, country_iso, pr AS price, coalesce(nullif(currency, ''), 'EUR') AS currency,
 coalesce(nullif(category, ''), nullif(product_type, ''), nullif(kind, ''), family) AS category, coalesce(subcategory, '') AS subcategory, coalesce(product_type, '') AS product_type,
 coalesce(product_group, '') AS product_group, service, family, origin, '' AS destination, replace(origin, ' ', '_') AS route_signature, {', '.join(l for l, _ in vocab.CATALOG_FLAG_WORDS)},
 coalesce(active, 1) = 1 AS is_active, coalesce(sellable, 1) = 1 AS is_sellable, {_COMPACT.format(_tag_list)} AS tags, supplier_name, supplier_id, lat, lng,
 CAST(round(CASE WHEN clean_title <> '' THEN 0.2 ELSE 0 END + CASE WHEN clean_description <> '' THEN 0.1 ELSE 0 END + CASE WHEN city <> '' THEN 0.2 ELSE 0 END + CASE WHEN country <> '' THEN 0.15 ELSE 0 END + 0.1
  + CASE WHEN pr > 0 THEN 0.1 ELSE 0 END + CASE WHEN supplier_name <> '' THEN 0.1 ELSE 0 END, 2) AS DOUBLE) AS confidence,
 concat_ws(' | ', 'service:' || service, 'theme:' || family, 'from:' || nullif(origin, ''), 'city:' || nullif(city, ''), 'country:' || nullif(country, ''), 'flags:' || nullif({_COMPACT.format(_shown)}, ''), nullif(clean_title, ''), nullif(clean_description, '')) AS embedding_text FROM f""")
def _(t):
    rows = catalogue.catalogue_rows(derive(t.part, STAGE), derive(t.nation, STAGE_LOCALITIES), derive(t.lineitem, STAGE_DETAILS),
                                    derive(t.lineitem, STAGE_LINKS), derive(t.nation, STAGE_THEMES))
    return catalogue.catalogue_stage(rows, inputs.cities(t)).withColumn("tags", F.array_join("tags", ","))


# --- the service stage ------------------------------------------------------------------------
_SEP = "'|'"
SERVICE = [
    ("product_id", N), ("title", "title"), ("description", "description"), ("city", pick(N, "'Rome'", "''", "NULL", "' Oslo '", "split_part(title, ' ', 3)")),
    ("country", pick("p_size", "'Italy'", "'Unknown'", "NULL", "''")), ("price", pick("p_size", "price", "0.0", "NULL")), ("currency", pick(N, "'GBP'", "NULL")),
    ("activity", pick("p_size", "NULL", "' Transfer '", "'excursion'", "'ticket'", "''", "'Activity'", "NULL")),
    ("breadcrumb", pick(N, "NULL", "'home > wine tasting'", "''")), ("duration", "duration"), ("inclusions", pick("p_size", "'hiking boots'", "NULL")),
    ("page_description", pick(N, "'Opera SHOW tonight'", "NULL", "'yoga'", "''")), ("url", "url"), ("source", pick("p_size", "source", "''", "NULL")),
    ("platform", pick(N, "'shop'", "NULL", "''"))]
#: The layers as text, which both engines split.
LAYERS = [("access", pick(N, "NULL", "'ticket|guide'", "'seat'", "'show'", "'guide'", "NULL", "'seat'")),
          ("transport", pick("p_size", "'bus'", "'water_transfer'", "NULL", "'transfer|bus'", "'bus'"))]
_SOURCE = "SELECT raw.*, p_partkey, p_size FROM raw JOIN part ON product_id = p_partkey"
_scores = ", ".join(f"{hits('low', kws)} AS n{i}" for i, (_, kws) in enumerate(vocab.SERVICE_VOCABULARY))
_top = "greatest(" + ", ".join(f"n{i}" for i in range(len(vocab.SERVICE_VOCABULARY))) + ")"
_label = "CASE " + " ".join(f"WHEN n{i} = {_top} THEN {quoted(label)}" for i, (label, _) in enumerate(vocab.SERVICE_VOCABULARY)) + " END"
_layered = " ".join(f"WHEN len(list_intersect(string_split({name}, {_SEP}), [{', '.join(map(quoted, words))}])) > 0 THEN {quoted(label)}"
                    for name, (label, words) in zip(("access", "transport"), vocab.SERVICE_LAYERS, strict=True))
_typed = f"CASE WHEN {in_list('upper(trim(activity))', vocab.OWN_SERVICES)} THEN upper(trim(activity)) {_layered} WHEN {_top} / sqrt(greatest(length(low), 100)) > 0.02 THEN {_label} ELSE 'TOUR' END"
_SERVICE_SQL = f"{inputs.RAW_SQL}, s AS (SELECT {select(SERVICE)}, {select(LAYERS)} FROM ({_SOURCE}))"


def _service_rows(t):
    joined = inputs.raw(t).join(t.part.select("p_partkey", "p_size"), c("product_id") == c("p_partkey"))
    return derive(joined, SERVICE + LAYERS).withColumn("access", F.split("access", r"\|")).withColumn("transport", F.split("transport", r"\|"))


@query("cls4_overrides", f"""
WITH {_SERVICE_SQL}, x AS (SELECT *, {_scores} FROM (SELECT *, lower(title || ' ' || description) AS low FROM s)) SELECT product_id, {_typed} AS service FROM x""")
def _(t):
    low = F.lower(F.concat_ws(" ", "title", "description"))
    return _service_rows(t).select("product_id", catalogue.service_type(low, c("activity"), c("access"), c("transport")).alias("service"))


_clean = sql_squeeze(sql_replace("regexp_replace(" + sql_replace("coalesce(trim(description), '')", "<[^>]+>", "' '") + r", 'https?://\S+', '', 'g')",
                                 "|".join(vocab.MARKETING_PHRASES), "''", "gi"))
_market = case_words("lower(coalesce(url, '') || ' ' || coalesce(source, ''))", vocab.MARKETPLACE_SOURCES,
                     "(CASE WHEN coalesce(source, '') <> '' THEN upper(source) ELSE 'DIRECT_SUPPLIER' END)")
_rule = case_words("lower(title || ' ' || coalesce(description, ''))", [([k], v) for k, v in vocab.PRICE_RULES],
                   "(" + case_equal("lower(coalesce(activity, ''))", vocab.PRICE_BY_ACTIVITY, "CAST(75 AS DOUBLE)") + ")")
_minutes = "nullif(" + " + ".join(f"coalesce(try_cast(nullif(regexp_extract(lower(duration), {quoted(p)}, 1), '') AS INTEGER), 0) * {k}" for p, k in vocab.DURATION_PATTERNS) + ", 0)"
_all_tags = ", ".join(f"CASE WHEN {any_of('low', kws)} THEN {quoted(label)} END" for label, kws in sorted(vocab.TAG_WORDS))
_WORD = r"[\p{L}\p{M}\p{N}_]"


def _wide(pattern: str) -> str:
    r"""The pattern with \w as all letters, digits and the underscore."""
    return pattern.replace(r"[\w\s\-]", r"[\p{L}\p{M}\p{N}_\s\-]").replace(r"\w", _WORD)


def _route(group: int) -> str:
    arms = " ".join(f"WHEN regexp_matches(rt, {quoted(_wide(p))}) THEN {_title('regexp_extract(rt, ' + quoted(_wide(p)) + f', {group})')}" for p in vocab.ROUTE_PATTERNS)
    words = " ".join(f"WHEN contains(rt, {quoted(w)}) THEN {quoted(w.upper() if group == 1 else '')}" for w in vocab.AIRPORT_WORDS)
    return f"CASE {arms} {words} ELSE '' END"


def _title(value: str) -> str:
    return f"array_to_string(list_transform(string_split(trim({value}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query("cls12_service", f"""
WITH {inputs.CITIES_SQL}, {_SERVICE_SQL}, ci AS (SELECT lower(trim(name)) AS key, arg_min(country, city_id) AS found FROM cities GROUP BY 1),
a AS (SELECT *, {_marketing.replace('title', 'trim(title)', 1)} AS clean_title, {_clean} AS clean_description, trim(coalesce(city, '')) AS c0, trim(coalesce(country, '')) AS na FROM s WHERE length(trim(title)) >= 5),
b AS (SELECT a.*, CASE WHEN lower(na) IN ('', 'unknown') THEN coalesce(CASE WHEN c0 <> '' THEN coalesce({case_equal('lower(c0)', vocab.CITY_COUNTRIES)}, found) END, '') ELSE na END AS n,
 CASE WHEN c0 <> '' THEN c0 ELSE {case_words("lower(clean_title || ' ' || clean_description)", [([k], k.title()) for k, _ in vocab.CITY_COUNTRIES], '')} END AS ct,
 lower(clean_title || ' ' || clean_description || ' ' || coalesce(page_description, '')) AS low FROM a LEFT JOIN ci ON ci.key = nullif(lower(c0), '')),
d AS (SELECT *, {_scores}, low || ' ' || lower(coalesce(breadcrumb, '') || ' ' || coalesce(duration, '') || ' ' || coalesce(inclusions, '')) AS ctx, lower(clean_title) || ' ' || low AS rt,
 {', '.join(f'{any_of("low", kws)} AS {l}' for l, kws in vocab.FLAG_WORDS)}, CASE WHEN price > 0 THEN CAST(price AS DOUBLE) ELSE {_rule} END AS pr, {_minutes} AS mins, {_COMPACT.format(_all_tags)} AS tags FROM b),
e AS (SELECT *, {_typed} AS service, {case_words('ctx', [([k], f) for k, f, _ in vocab.THEME_RULES], 'TOURS_SIGHTSEEING')} AS family, {case_words('ctx', [([k], s) for k, _, s in vocab.THEME_RULES], 'SIGHTSEEING')} AS subtype,
 {_route(1)} AS origin, {_route(2)} AS destination FROM d)
SELECT product_id, clean_title, clean_description, ct AS city, n AS country, {case_equal('service', vocab.SERVICE_CATEGORIES, "'Tours & Sightseeing'")} AS category, {case_equal('service', vocab.SERVICE_KINDS, "'excursion'")} AS kind,
 service, subtype, family, origin, destination, CASE WHEN origin <> '' AND destination <> '' THEN upper(origin) || '→' || upper(destination) ELSE '' END AS route_signature, {', '.join(l for l, _ in vocab.FLAG_WORDS)}, tags, pr AS price,
 coalesce(currency, 'EUR') AS currency, mins AS duration_minutes, coalesce(platform, '') AS supplier, {_market} AS marketplace,
 CAST(round(CASE WHEN clean_title <> '' THEN 0.2 ELSE 0 END + CASE WHEN clean_description <> '' THEN 0.1 ELSE 0 END + CASE WHEN ct <> '' THEN 0.2 ELSE 0 END + CASE WHEN n <> '' THEN 0.15 ELSE 0 END + 0.1
  + CASE WHEN pr > 0 THEN 0.1 ELSE 0 END + CASE WHEN coalesce(platform, '') <> '' THEN 0.1 ELSE 0 END + CASE WHEN mins > 0 THEN 0.05 ELSE 0 END, 2) AS DOUBLE) AS confidence,
 concat_ws(' | ', 'service:' || service, 'theme:' || family, 'from:' || nullif(origin, ''), 'to:' || nullif(destination, ''), 'city:' || nullif(ct, ''), 'country:' || nullif(n, ''), 'flags:' || nullif({_COMPACT.format(_shown)}, ''),
  'tags:' || nullif(tags, ''), nullif(clean_title, ''), nullif(clean_description, '')) AS embedding_text FROM e""")
def _(t):
    return catalogue.service_stage(_service_rows(t), inputs.cities(t)).withColumn("tags", F.array_join("tags", ","))
