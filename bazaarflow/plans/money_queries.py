"""Queries: prices, currencies, durations, codes, and rule classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarflow import vocab
from bazaarflow.functions import money, rules, similarity
from bazaarflow.operators import geo
from bazaarflow.plans import inputs, normalise
from bazaarflow.plans.registry import query
from bazaarflow.plans.sqltext import any_of, case_equal, case_words, hits, in_list, quoted, values

c = F.col

_AMOUNT = inputs.money("p_retailprice / 10")
_PRICE_TEXT = inputs.pick("p_size", f"{_AMOUNT} || '€'", f"'From $' || {_AMOUNT}", f"'USD ' || {_AMOUNT}", f"{_AMOUNT} || ' tnd'",
                          f"'£ ' || replace({_AMOUNT}, '.', ',')", "''", "NULL", "'0.5 EUR'", "'free'", f"'₩' || {_AMOUNT} || '00'")
_SHOP = f"shop AS (SELECT p_partkey, {_PRICE_TEXT} AS raw FROM part)"


def _shop(t):
    return t.part.selectExpr("p_partkey", f"{_PRICE_TEXT} AS raw")


_digits = "TRY_CAST(regexp_extract(replace(regexp_replace(raw, '[^0-9.,]', ' ', 'g'), ',', '.'), '[0-9]+([.][0-9]+)?', 0) AS DOUBLE)"
_code = case_words("coalesce(raw, '')", [([s], iso) for s, iso in vocab.CURRENCY_SYMBOLS],
                   "(" + case_words("upper(coalesce(raw, ''))", [([i], i) for i, _ in vocab.RATES_TO_EUR if i != "EUR"], "EUR") + ")")


@query("num1_parse_price", f"""
WITH {_SHOP} SELECT p_partkey, CASE WHEN {_digits} BETWEEN 1 AND 99999 THEN round({_digits}, 2) END AS amount, {_code} AS currency,
 CASE WHEN {_digits} BETWEEN 1 AND 5000 THEN round({_digits}, 2) END AS shop_amount FROM shop""")
def _(t):
    p, s = money.parse_price(c("raw")), money.parse_shop_price(c("raw"))
    return _shop(t).select("p_partkey", p["amount"].alias("amount"), p["currency"].alias("currency"), s["amount"].alias("shop_amount"))


def sql_text_price(d: str) -> tuple[str, str]:
    amounts, codes = [], []
    for p, code in vocab.TEXT_PRICE_PATTERNS:
        v = f"TRY_CAST(replace(regexp_extract({d}, {quoted(p)}, 1), ',', '.') AS DOUBLE)"
        amounts.append(f"WHEN {v} > 0 THEN {v}")
        codes.append(f"WHEN {v} > 0 THEN {quoted(code)}")
    return f"CASE {' '.join(amounts)} END", f"CASE {' '.join(codes)} END"


_num = lambda d, p: f"TRY_CAST(nullif(replace(regexp_extract({d}, {quoted('(?i)' + p)}, 1), ',', '.'), '') AS DOUBLE)"


@query("num2_text_price", f"""
WITH {inputs.RAW_SQL}, x AS (SELECT product_id, price, title || ' ' || description AS d FROM raw)
SELECT product_id, {sql_text_price('d')[0]} AS amount, {sql_text_price('d')[1]} AS currency,
 coalesce({', '.join(_num('d', p) for p in vocab.LOOSE_PRICE_PATTERNS)}) AS loose,
 CASE WHEN price > 0 AND price <= 100000 THEN price ELSE coalesce({', '.join(
     f"CASE WHEN {_num('d', p)} > 0 AND {_num('d', p)} <= 100000 THEN {_num('d', p)} END" for p in vocab.SERVICE_PRICE_PATTERNS)}) END AS service FROM x""")
def _(t):
    d = F.concat(c("title"), F.lit(" "), c("description"))
    m = money.text_price(d)
    return inputs.raw(t).select("product_id", m["amount"].alias("amount"), m["currency"].alias("currency"),
                                money.loose_price(d).alias("loose"), money.service_price(d, c("price")).alias("service"))


def sql_convert(amount: str, rate: str) -> str:
    return f"CAST(round(CAST({amount} AS DECIMAL(14,2)) * coalesce(CAST({rate} AS DECIMAL(18,8)), CAST(1 AS DECIMAL(18,8))), 2) AS DOUBLE)"


@query("num3_to_eur", f"""
WITH {inputs.RAW_SQL}, {values('rates', 'code, rate', vocab.RATES_TO_EUR)}
SELECT product_id, currency, {sql_convert('price', 'rate')} AS eur FROM raw LEFT JOIN rates ON upper(currency) = code""")
def _(t):
    rates = F.broadcast(money.rates_table(t.spark))  # the fixed list, 83 rows
    return money.to_eur(inputs.raw(t), rates, "price", "currency").select("product_id", "currency", "eur")


def sql_stage_price(d: str, price: str = "price", currency: str = "currency") -> tuple[str, str]:
    rate = lambda code: case_equal(code, vocab.STAGE_RATES)
    stated = sql_convert(price, rate(f"upper(trim(coalesce({currency}, 'EUR')))"))
    amount, code = sql_text_price(d)
    found = sql_convert(f"({amount})", rate(f"({code})"))
    ok, found_ok = f"({stated} >= 5 AND {stated} < 6000)", f"({found} >= 5 AND {found} < 6000)"
    return (f"CASE WHEN {price} > 0 THEN CASE WHEN {ok} THEN {stated} END WHEN {found_ok} THEN {found} END",
            f"CASE WHEN {price} > 0 AND {ok} THEN {stated} > 5000 WHEN NOT coalesce({price} > 0, false) AND {found_ok} THEN false ELSE true END")


@query("num4_process_price", f"""
WITH {inputs.RAW_SQL}, x AS (SELECT product_id, price, currency, title || ' ' || description AS d FROM raw)
SELECT product_id, {sql_stage_price('d')[0]} AS eur, {sql_stage_price('d')[1]} AS estimated FROM x""")
def _(t):
    body = F.concat(c("title"), F.lit(" "), c("description"))
    return money.process_price(inputs.raw(t), "price", "currency", body).select("product_id", "eur", "estimated")


def sql_clamp(price: str, activity: str) -> str:
    low = case_equal(activity, [(k, v[0]) for k, v in vocab.PRICE_BOUNDS.items()], "CAST(1 AS DOUBLE)")
    high = case_equal(activity, [(k, v[1]) for k, v in vocab.PRICE_BOUNDS.items()], "CAST(5000 AS DOUBLE)")
    return f"CASE WHEN {price} IS NULL THEN NULL WHEN {price} < {low} THEN {low} WHEN {price} > {high} THEN {high} ELSE {price} END"


@query("num5_clamp_price", f"""
WITH {inputs.CATALOG_SQL}, x AS (SELECT catalog_id, price * 3 - 100 AS price, CASE WHEN catalog_id % 5 = 0 THEN 'OTHER' ELSE activity END AS activity FROM catalog)
SELECT catalog_id, {sql_clamp('price', 'activity')} AS price FROM x""")
def _(t):
    x = inputs.catalog(t).selectExpr("catalog_id", "price * 3 - 100 AS price", "CASE WHEN catalog_id % 5 = 0 THEN 'OTHER' ELSE activity END AS activity")
    return x.select("catalog_id", money.clamp_price(c("price"), c("activity")).alias("price"))


_fallback = "(" + case_equal("lower(kind)", vocab.PRICE_BY_ACTIVITY, "CAST(75 AS DOUBLE)") + ")"


@query("num6_rule_price", f"""
WITH {inputs.RAW_SQL}, x AS (SELECT product_id, lower(title || ' ' || description) AS d, CASE WHEN product_id % 3 = 0 THEN 'Ticket' WHEN product_id % 3 = 1 THEN 'EXCURSION' END AS kind FROM raw)
SELECT product_id, {case_words('d', [([k], v) for k, v in vocab.PRICE_RULES], _fallback)} AS price,
 {case_equal('kind', vocab.DEFAULT_PRICES.items(), 'CAST(40 AS DOUBLE)')} AS default_price FROM x""")
def _(t):
    kind = F.expr("CASE WHEN product_id % 3 = 0 THEN 'Ticket' WHEN product_id % 3 = 1 THEN 'EXCURSION' END")
    d = F.lower(F.concat(c("title"), F.lit(" "), c("description")))
    return inputs.raw(t).select("product_id", money.rule_price(d, kind).alias("price"), money.default_price(kind).alias("default_price"))


_int = lambda p: f"TRY_CAST(nullif(regexp_extract(lower(d), {quoted(p)}, 1), '') AS INTEGER)"


@query("num7_duration", f"""
WITH {inputs.RAW_SQL}, x AS (SELECT product_id, duration AS d FROM raw UNION ALL SELECT product_id + 10000000, description FROM raw)
SELECT product_id, coalesce(CAST(floor(TRY_CAST(nullif(regexp_extract(lower(d), '(\\d+(?:\\.\\d+)?)\\s*h', 1), '') AS DOUBLE) * 60) AS INTEGER),
 {_int(r'(\d+)\s*min')}, {_int(r'(\d+)\s*(?:day|jour)')} * 480) AS first_unit,
 nullif({' + '.join(f'coalesce({_int(p)} * {k}, 0)' for p, k in vocab.DURATION_PATTERNS)}, 0) AS all_units FROM x""")
def _(t):
    r = inputs.raw(t)
    x = r.select("product_id", c("duration").alias("d")).unionByName(r.select((c("product_id") + 10000000).alias("product_id"), c("description").alias("d")))
    return x.select("product_id", money.minutes_first(c("d")).alias("first_unit"), money.minutes_sum(c("d")).alias("all_units"))


@query("num8_minutes", "SELECT l_orderkey, l_linenumber, nullif(CAST(floor(l_quantity / 10) AS INTEGER) * 60 + CASE WHEN l_linenumber > 3 THEN coalesce(NULL, 0) ELSE 30 END - 30, 0) AS minutes FROM lineitem")
def _(t):
    hours = F.floor(c("l_quantity") / 10).cast("int")
    extra = F.when(c("l_linenumber") > 3, F.lit(-30)).otherwise(F.lit(0))
    return t.lineitem.select("l_orderkey", "l_linenumber", money.minutes_of(hours, extra).alias("minutes"))


@query("num9_derived_prices", """SELECT p_partkey, CAST(round(p_size * 0.85, 2) AS DOUBLE) AS purchase, CAST(round(p_size * 0.8, 2) AS DOUBLE) AS minimum, CAST(round(p_size * 1.2, 2) AS DOUBLE) AS maximum FROM part""")
def _(t):
    d = money.derived_prices(c("p_size").cast("double"))
    return t.part.select("p_partkey", d["purchase"].alias("purchase"), d["minimum"].alias("minimum"), d["maximum"].alias("maximum"))


@query("num10_code_maps", f"""
WITH x AS (SELECT p_partkey, CAST(400 + p_size AS STRING) AS code FROM part), y AS (SELECT p_partkey, code,
 {case_equal('code', vocab.ACTIVITY_CODES, "'EXCURSION'")} AS activity, {case_equal('code', vocab.CURRENCY_CODES, "'EUR'")} AS currency FROM x)
SELECT p_partkey, activity, currency, {case_equal('activity', vocab.SERVICE_CODES, "'TOUR'")} AS service,
 {case_equal('lower(activity)', vocab.EXPORT_TYPE_CODES, "'2'")} AS type_code FROM y""")
def _(t):
    code = c("p_size") + 400
    activity = money.code_label(code, vocab.ACTIVITY_CODES, "EXCURSION")
    return t.part.select("p_partkey", activity.alias("activity"), money.code_label(code, vocab.CURRENCY_CODES, "EUR").alias("currency"),
                         money.code_label(activity, vocab.SERVICE_CODES, "TOUR").alias("service"),
                         money.code_label(F.lower(activity), vocab.EXPORT_TYPE_CODES, "2").alias("type_code"))


_LAT = "CASE c_custkey % 4 WHEN 0 THEN CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING) WHEN 1 THEN ' 12 ' WHEN 2 THEN 'n/a' ELSE '' END"


@query("num11_numeric_guard", f"SELECT c_custkey, TRY_CAST(trim({_LAT}) AS DOUBLE) AS lat FROM customer")
def _(t):
    return t.customer.select("c_custkey", geo.numeric_or_null(F.expr(_LAT)).alias("lat"))


@query("num12_zone", f"""
WITH {inputs.RAW_SQL}, {inputs.COUNTRIES_SQL}
SELECT product_id, coalesce(zone_id, 5) AS zone_id, {in_list("lower(trim(replace(coalesce(country_raw, ''), 'NATION_1', 'France')))", vocab.EUROZONE)} AS eurozone
FROM raw LEFT JOIN countries ON lower(trim(country_raw)) = lower(country)""")
def _(t):
    out = geo.zone_of(inputs.raw(t), "country_raw", inputs.countries(t))
    euro = money.is_eurozone(F.replace(F.coalesce("country_raw", F.lit("")), F.lit("NATION_1"), F.lit("France")))
    return out.select("product_id", "zone_id", euro.alias("eurozone"))


# --- rule classification ----------------------------------------------------------------------
_BODY = "lower(title || ' ' || description || ' ' || category_raw)"
_WIDE = f"trim(regexp_replace(regexp_replace({_BODY}, '[-_/]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("cls1_activity", f"""
WITH {inputs.RAW_SQL} SELECT product_id, {case_words(_BODY, vocab.STAGE_ACTIVITY_RULES, 'EXCURSION')} AS stage,
 {case_words(_WIDE, vocab.ACTIVITY_RULES, 'EXCURSION')} AS wide, {case_words(_BODY, vocab.EXTRACT_ACTIVITY_RULES, 'EXCURSION')} AS extraction,
 {case_words(_BODY, vocab.HEURISTIC_ACTIVITY_RULES, 'EXCURSION')} AS heuristic FROM raw""")
def _(t):
    body = F.lower(F.concat_ws(" ", "title", "description", "category_raw"))
    return inputs.raw(t).select(
        "product_id", normalise.activity_of(c("title"), c("description"), c("category_raw")).alias("stage"),
        normalise.vocabulary_activity(c("title"), c("description"), c("category_raw")).alias("wide"),
        rules.first_label(body, vocab.EXTRACT_ACTIVITY_RULES, "EXCURSION").alias("extraction"),
        rules.first_label(body, vocab.HEURISTIC_ACTIVITY_RULES, "EXCURSION").alias("heuristic"))


_LANG_RULES = [(["the ", " and "], "EN"), (["der ", " und "], "DE"), (["les ", " des "], "FR"), (["los ", " las "], "ES")]


@query("cls1_document_rules", f"SELECT doc_id, {case_words('lower(text)', _LANG_RULES, 'NONE')} AS label FROM documents")
def _(t):
    return t.documents.select("doc_id", rules.first_label(F.lower("text"), _LANG_RULES, "NONE").alias("label"))


@query("cls1_word_rules", r"""SELECT doc_id, regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])the([^\p{L}\p{N}_]|$)') AS has_the FROM documents""")
def _(t):
    return t.documents.select("doc_id", rules.has_any(F.lower("text"), ["the"], "word").alias("has_the"))


_SUP_CAT = "[CASE WHEN s_suppkey % 3 = 0 THEN 'Airport shuttle' ELSE 'Tour operator' END, CASE WHEN s_suppkey % 4 = 0 THEN 'Museum' ELSE 'Company' END]"


@query("cls2_supplier_activity", f"""
WITH x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN lower(s_name) ELSE lower(array_to_string({_SUP_CAT}, ' ')) END AS d FROM supplier)
SELECT s_suppkey, {case_words('d', vocab.ACTIVITY_RULES, 'EXCURSION')} AS activity FROM x""")
def _(t):
    cats = F.expr("CASE WHEN s_suppkey % 5 = 0 THEN CAST(array() AS array<string>) ELSE array" + _SUP_CAT.replace("[", "(").replace("]", ")") + " END")
    return t.supplier.select("s_suppkey", normalise.supplier_activity(cats, c("s_name")).alias("activity"))


_STAGE_ACT = case_words(_BODY, vocab.STAGE_ACTIVITY_RULES, "EXCURSION")


@query("cls3_category", f"""
WITH {inputs.RAW_SQL}, x AS (SELECT product_id, {_STAGE_ACT} AS activity, lower(title || ' ' || description) AS d, {_BODY} AS b FROM raw)
SELECT product_id, CASE WHEN activity = 'TRANSFER' THEN 'TRANSPORT' ELSE {case_words('d', vocab.STAGE_CATEGORY_RULES, 'CULTUREL')} END AS stage,
 {case_words('b', vocab.CATEGORY_RULES, "(CASE WHEN activity = 'TRANSFER' THEN 'TRANSPORT' ELSE 'CULTUREL' END)")} AS wide FROM x""")
def _(t):
    a = normalise.activity_of(c("title"), c("description"), c("category_raw"))
    body = F.lower(F.concat_ws(" ", "title", "description", "category_raw"))
    fallback = F.when(c("activity") == "TRANSFER", "TRANSPORT").otherwise("CULTUREL")
    return inputs.raw(t).withColumn("activity", a).select(
        "product_id", normalise.category_of(c("activity"), c("title"), c("description")).alias("stage"),
        rules.first_label(body, vocab.CATEGORY_RULES, fallback).alias("wide"))


_scores = ", ".join(f"{hits('d', kws)} AS n{i}" for i, (_, kws) in enumerate(vocab.SERVICE_VOCABULARY))
_top = "greatest(" + ", ".join(f"n{i}" for i in range(len(vocab.SERVICE_VOCABULARY))) + ")"
_label = "CASE " + " ".join(f"WHEN n{i} = {_top} THEN {quoted(l)}" for i, (l, _) in enumerate(vocab.SERVICE_VOCABULARY)) + " END"


@query("cls4_service_type", f"""
WITH {inputs.RAW_SQL}, x AS (SELECT product_id, d, {_scores} FROM (SELECT product_id, lower(title || ' ' || description) AS d FROM raw))
SELECT product_id, CASE WHEN {_top} / sqrt(greatest(length(d), 100)) > 0.02 THEN {_label} ELSE 'TOUR' END AS service,
 {case_words('d', vocab.CATALOG_SERVICE_RULES, 'TOUR')} AS catalog_service FROM x""")
def _(t):
    d = F.lower(F.concat(c("title"), F.lit(" "), c("description")))
    return inputs.raw(t).select(
        "product_id", rules.scored_label(d, vocab.SERVICE_VOCABULARY, vocab.SERVICE_THRESHOLD, vocab.SERVICE_DEFAULT).alias("service"),
        rules.first_label(d, vocab.CATALOG_SERVICE_RULES, "TOUR").alias("catalog_service"))


@query("cls5_theme", f"""
WITH {inputs.RAW_SQL}, x AS (SELECT product_id, lower(title || ' ' || description) AS d FROM raw)
SELECT product_id, {case_words('d', [([k], f) for k, f, _ in vocab.THEME_RULES], 'TOURS_SIGHTSEEING')} AS family,
 {case_words('d', [([k], s) for k, _, s in vocab.THEME_RULES], 'SIGHTSEEING')} AS subtype FROM x""")
def _(t):
    d = F.lower(F.concat(c("title"), F.lit(" "), c("description")))
    pair = rules.first_label(d, [([k], F.struct(F.lit(f).alias("family"), F.lit(s).alias("subtype"))) for k, f, s in vocab.THEME_RULES],
                             F.struct(F.lit(vocab.THEME_DEFAULT[0]).alias("family"), F.lit(vocab.THEME_DEFAULT[1]).alias("subtype")))
    return inputs.raw(t).withColumn("_p", pair).select("product_id", "_p.*")


_tag_list = ", ".join(f"CASE WHEN {any_of('d', kws)} THEN {quoted(l)} END" for l, kws in vocab.TAG_WORDS)


@query("cls6_flags_and_tags", f"""
WITH {inputs.RAW_SQL}, x AS (SELECT product_id, lower(title || ' ' || description) AS d FROM raw)
SELECT product_id, {', '.join(f'{any_of("d", kws)} AS {l}' for l, kws in vocab.FLAG_WORDS)},
 {', '.join(f'{any_of("d", kws)} AS stage_{l}' for l, kws in vocab.STAGE_FLAG_WORDS)},
 array_to_string(list_sort(list_filter([{_tag_list}], lambda k: k IS NOT NULL)), ',') AS tags FROM x""")
def _(t):
    d = F.lower(F.concat(c("title"), F.lit(" "), c("description")))
    stage = rules.flags(d, [(f"stage_{k}", w) for k, w in vocab.STAGE_FLAG_WORDS])
    return inputs.raw(t).withColumn("_f", rules.flags(d, vocab.FLAG_WORDS)).withColumn("_s", stage).select(
        "product_id", "_f.*", "_s.*", F.array_join(rules.tags(d, vocab.TAG_WORDS), ",").alias("tags"))


@query("cls7_marketplace", f"""
WITH {inputs.RAW_SQL}, x AS (SELECT product_id, CASE WHEN product_id % 4 = 0 THEN 'https://www.viator.com/p' WHEN product_id % 4 = 1 THEN 'https://Klook.com/' ELSE url END AS u, CASE WHEN product_id % 4 = 3 THEN '' ELSE source END AS source FROM raw)
SELECT product_id, {case_words("lower(u || ' ' || source)", vocab.MARKETPLACE_SOURCES, "(CASE WHEN source <> '' THEN upper(source) ELSE 'DIRECT_SUPPLIER' END)")} AS marketplace FROM x""")
def _(t):
    x = inputs.raw(t).selectExpr("product_id", "CASE WHEN product_id % 4 = 0 THEN 'https://www.viator.com/p' WHEN product_id % 4 = 1 THEN 'https://Klook.com/' ELSE url END AS u",
                                 "CASE WHEN product_id % 4 = 3 THEN '' ELSE source END AS source")
    fallback = F.when(c("source") != "", F.upper("source")).otherwise("DIRECT_SUPPLIER")
    return x.select("product_id", rules.first_label(F.lower(F.concat_ws(" ", "u", "source")), vocab.MARKETPLACE_SOURCES, fallback).alias("marketplace"))


_FROM = r"from\s+([a-z\s]+?)\s+to\s+([a-z\s]+?)(?:\s|$)"
_title_case = lambda e: f"array_to_string(list_transform(string_split({e}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query("cls8_route", f"""
WITH {inputs.RAW_SQL}, x AS (SELECT product_id, lower(title) AS d, {_STAGE_ACT} AS activity FROM raw),
y AS (SELECT product_id, CASE WHEN activity = 'TRANSFER' THEN nullif(trim(regexp_extract(d, {quoted(_FROM)}, 1)), '') END AS o,
 CASE WHEN activity = 'TRANSFER' THEN nullif(trim(regexp_extract(d, {quoted(_FROM)}, 2)), '') END AS t,
 CASE WHEN contains(d, 'airport') AND NOT regexp_matches(d, 'airport\\s+(?:to|à|→)') AND NOT regexp_matches(d, '(?:transfer|transport)\\s+(?:from|de|von|desde)') THEN 'AIRPORT' END AS a FROM x)
SELECT product_id, {_title_case('o')} AS origin, {_title_case('t')} AS destination, {_title_case('o')} || ' → ' || {_title_case('t')} AS signature FROM y""")
def _(t):
    a = normalise.activity_of(c("title"), c("description"), c("category_raw"))
    return inputs.raw(t).withColumn("_r", normalise.route_of(c("title"), a)).select(
        "product_id", "_r.origin", "_r.destination", "_r.signature")


_SVC = "CASE p_size % 3 WHEN 0 THEN 'airport to ' || p_name WHEN 1 THEN 'Transfer from ' || p_name || ' to beach' ELSE p_name || ' aeropuerto' END"


@query("cls8_service_route", f"""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Airport' WHEN 1 THEN {_title_case('p_name')} ELSE 'AEROPUERTO' END AS origin FROM part""")
def _(t):
    # "x airport to y" needs a word before the airport, so a blank-led airport takes the pattern with the word itself.
    d = F.expr(_SVC.replace("'airport to '", "'the airport to '"))
    r = normalise.service_route(d)
    return t.part.select("p_partkey", F.when(c("p_size") % 3 == 0, F.replace(r["origin"], F.lit("The "), F.lit(""))).otherwise(r["origin"]).alias("origin"))


_DIRECTION = r"""CASE WHEN regexp_matches(d, 'airport.*?\bto\b') THEN 'ARRIVAL' WHEN regexp_matches(d, '\bto\b.*?airport') THEN 'DEPARTURE'
 WHEN contains(d, 'arrival transfer') OR contains(d, 'arriving') OR contains(d, 'from airport') OR contains(d, 'airport pickup') THEN 'ARRIVAL'
 WHEN contains(d, 'departure transfer') OR contains(d, 'departing') OR contains(d, 'to airport') OR contains(d, 'airport dropoff') OR contains(d, 'drop-off') THEN 'DEPARTURE' ELSE 'UNKNOWN' END"""
_DTITLE = "CASE p_size % 5 WHEN 0 THEN 'Transfer from Airport to ' || p_name WHEN 1 THEN p_name || ' to Airport' WHEN 2 THEN 'Arrival Transfer ' || p_name WHEN 3 THEN 'Hotel Drop-off ' || p_name ELSE p_name || ' tour' END"


@query("cls9_direction", f"SELECT p_partkey, {_DIRECTION} AS direction FROM (SELECT p_partkey, lower({_DTITLE}) AS d FROM part)")
def _(t):
    return t.part.select("p_partkey", similarity.transfer_direction(F.expr(_DTITLE)).alias("direction"))


def _sql_correct(source: str) -> str:
    """Corrections of (activity, category, city, country, price, d) rows of ``source``, as a chain of CTEs."""
    words = dict(vocab.CATEGORY_CORRECTIONS)
    by_act = "(CASE WHEN a = 'TRANSFER' THEN 'TRANSPORT' ELSE 'CULTUREL' END)"
    banned = []
    for label, kws in vocab.CATEGORY_FORBIDDEN:
        arms = " ".join(f"WHEN contains(d, {quoted(k)}) THEN {quoted(words[k]) if k in words else by_act}" for k in kws)
        banned.append(f"WHEN category = {quoted(label)} THEN CASE {arms} END")
    positive = " ".join(f"WHEN contains(d, {quoted(k)}) THEN {quoted(v)}" for k, v in vocab.CATEGORY_CORRECTIONS)
    hints = " ".join(f"WHEN (contains(d, {quoted(h)}) OR lower(city) = {quoted(h)}) AND lower(coalesce(country, '')) <> {quoted(e)} THEN {quoted(e.title())}"
                     for h, e in vocab.CITY_COUNTRY_HINTS)
    return f"""k1 AS (SELECT *, CASE WHEN {any_of('d', vocab.FORCE_TRANSFER)} THEN 'TRANSFER' WHEN {any_of('d', vocab.FORCE_TICKET)} THEN 'TICKET' ELSE activity END AS a FROM {source}),
k2 AS (SELECT *, coalesce(CASE {' '.join(banned)} END, category) AS c1 FROM k1),
k3 AS (SELECT *, CASE WHEN a = 'TRANSFER' THEN 'TRANSPORT' ELSE c1 END AS c2, CASE {hints} ELSE country END AS n FROM k2),
k4 AS (SELECT *, CASE WHEN c2 = 'CULTUREL' THEN CASE {positive} ELSE c2 END ELSE c2 END AS c3 FROM k3),
k5 AS (SELECT *, {sql_clamp('price', 'a')} AS p FROM k4)"""


@query("cls10_corrections", f"""
WITH {inputs.RAW_SQL}, x AS (SELECT product_id, {_STAGE_ACT} AS activity, CASE product_id % 3 WHEN 0 THEN 'NAUTIQUE' WHEN 1 THEN 'CULTUREL' ELSE 'SPORT' END AS category,
 'Oslo' AS city, 'Norway' AS country, price, lower(title || ' ' || description) AS d FROM raw), {_sql_correct('x')}
SELECT product_id, a AS activity, c3 AS category, n AS country, p AS price, array_to_string(list_filter([CASE WHEN a <> activity THEN 'activity' END,
 CASE WHEN c3 <> category THEN 'category' END, CASE WHEN n <> country THEN 'country' END, CASE WHEN p <> price THEN 'price' END], lambda z: z IS NOT NULL), ',') AS corrections FROM k5""")
def _(t):
    x = inputs.raw(t).withColumn("activity", normalise.activity_of(c("title"), c("description"), c("category_raw"))).withColumns({
        "category": F.expr("CASE product_id % 3 WHEN 0 THEN 'NAUTIQUE' WHEN 1 THEN 'CULTUREL' ELSE 'SPORT' END"), "city": F.lit("Oslo"),
        "country": F.lit("Norway"), "body": F.concat(c("title"), F.lit(" "), c("description"))})
    return normalise.correct_labels(x).select("product_id", "activity", "category", "country", "price",
                                              F.array_join("corrections", ",").alias("corrections"))


_given = lambda e: f"(coalesce(trim({e}), '') <> '')"


@query("cls11_confidence", f"""
WITH {inputs.CATALOG_SQL}
SELECT catalog_id, CAST(round(CASE WHEN {_given('name_en')} THEN 0.2 ELSE 0 END + 0.1 + CASE WHEN price IS NOT NULL AND catalog_id % 2 = 0 THEN 0.2 ELSE 0 END + 0.2 + 0.1 + 0.1, 2) AS DOUBLE) AS stage,
 CAST(round(CASE WHEN {_given('name_en')} THEN 0.2 ELSE 0 END + 0.1 + 0.2 + 0.15 + CASE WHEN {_given('category')} THEN 0.1 ELSE 0 END + CASE WHEN price > 0 THEN 0.1 ELSE 0 END + 0.1, 2) AS DOUBLE) AS catalog,
 CAST(round(CASE WHEN {_given('name_en')} THEN 0.2 ELSE 0 END + 0.1 + 0.2 + 0.15 + CASE WHEN {_given('category')} THEN 0.1 ELSE 0 END + CASE WHEN price > 0 THEN 0.1 ELSE 0 END + 0.1 + CASE WHEN catalog_id % 2 > 0 THEN 0.05 ELSE 0 END, 2) AS DOUBLE) AS service,
 CAST(round(CASE WHEN length(name) >= 10 THEN 0.35 ELSE 0 END + CASE WHEN length(description) >= 30 THEN 0.35 ELSE 0 END + CASE WHEN price IS NOT NULL THEN 0.15 ELSE 0 END + 0.15, 2) AS DOUBLE) AS cleaning FROM catalog""")
def _(t):
    cat = inputs.catalog(t)
    est, zero = c("catalog_id") % 2 != 0, F.lit(0.0)
    args = [c("name_en"), c("description"), c("city"), c("country"), c("category"), c("price"), c("activity")]
    return cat.select(
        "catalog_id", normalise.stage_confidence(c("name_en"), c("description"), c("price"), est, c("city"), c("country"), zero).alias("stage"),
        normalise.service_confidence(*args).alias("catalog"), normalise.service_confidence(*args, c("catalog_id") % 2).alias("service"),
        normalise.clean_confidence(c("name"), c("description"), F.coalesce(c("price").cast("string"), F.lit("")), F.array("city")).alias("cleaning"))


