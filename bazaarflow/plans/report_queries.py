"""Queries: counts, pivots, rankings, queues, dedup, updates, price ladder and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarflow import vocab
from bazaarflow.functions.rules import first_label
from bazaarflow.functions.text import host, slug_text
from bazaarflow.operators import dedup, impute, reports, upsert
from bazaarflow.plans import inputs, normalise
from bazaarflow.plans.registry import query
from bazaarflow.plans.sqltext import case_equal, case_words
from bazaarflow.plans.text_queries import _host, sql_replace, sql_squeeze
from bazaarflow.session import scratch_path
from bazaarflow.streaming import incremental

c = F.col


@query("agg1_global_counts", """
SELECT 'orders' AS metric, count(*) AS value FROM orders UNION ALL SELECT 'open_orders', count(*) FILTER (WHERE o_orderstatus = 'O') FROM orders
UNION ALL SELECT 'customers', count(*) FROM customer UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'with_vector', count(embedding) FROM embeddings""")
def _(t):
    return reports.global_counts({"orders": t.orders, "customers": t.customer, "embeddings": t.embeddings},
                                 {"orders": {"open_orders": c("o_orderstatus") == "O"}, "embeddings": {"with_vector": c("embedding").isNotNull()}})


@query("agg2_review_funnel", f"""
WITH {inputs.MATCHES_SQL} SELECT count(*) FILTER (WHERE match_status = 'NEW_PRODUCT' AND validation_decision IS NULL) AS pending, count(*) FILTER (WHERE validation_decision = 'APPROVED') AS approved,
 count(*) FILTER (WHERE validation_decision = 'REJECTED') AS rejected, count(*) FILTER (WHERE match_status = 'SIMILAR') AS similar_, count(*) FILTER (WHERE match_status = 'ACCEPTED') AS integrated FROM matches""")
def _(t):
    s, d = c("match_status"), c("validation_decision")
    return reports.condition_counts(inputs.matches(t), {
        "pending": (s == "NEW_PRODUCT") & d.isNull(), "approved": d == "APPROVED", "rejected": d == "REJECTED", "similar_": s == "SIMILAR", "integrated": s == "ACCEPTED"})


@query("agg2_sync_status", f"""
WITH {inputs.MATCHES_SQL} SELECT count(*) FILTER (WHERE external_id IS NULL) AS pending, count(*) FILTER (WHERE external_id IS NOT NULL) AS synced,
 count(*) FILTER (WHERE price IS NULL AND external_id IS NULL) AS null_price FROM matches WHERE match_status = 'ACCEPTED'""")
def _(t):
    e = c("external_id")
    return reports.condition_counts(inputs.matches(t).where("match_status = 'ACCEPTED'"), {
        "pending": e.isNull(), "synced": e.isNotNull(), "null_price": c("price").isNull() & e.isNull()})


@query("agg2_supplier_accepted", f"""
WITH {inputs.MATCHES_SQL} SELECT customer_id, count(*) FILTER (WHERE match_status = 'ACCEPTED') AS accepted, count(*) FILTER (WHERE match_id IS NOT NULL) AS total FROM matches GROUP BY customer_id""")
def _(t):
    return reports.condition_counts(inputs.matches(t), {"accepted": c("match_status") == "ACCEPTED", "total": c("match_id").isNotNull()}, ["customer_id"])


@query("agg3_top_counts", f"""
WITH {inputs.MATCHES_SQL} SELECT n_name, count(*) AS n FROM matches JOIN customer ON customer_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE match_status = 'ACCEPTED' AND external_id IS NULL GROUP BY n_name ORDER BY n DESC, n_name LIMIT 10""")
def _(t):
    m = inputs.matches(t).where("match_status = 'ACCEPTED' AND external_id IS NULL")
    rows = m.join(t.customer, c("customer_id") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey"))
    return reports.top_counts(rows, ["n_name"], 10)


@query("agg3_type_counts", f"WITH {inputs.CATALOG_SQL} SELECT activity, city, count(*) AS n FROM catalog GROUP BY activity, city")
def _(t):
    return reports.top_counts(inputs.catalog(t), ["activity", "city"])


_CUST = """SELECT c_custkey, n_name AS city, r_name AS country, c_mktsegment AS activity, c_acctbal AS price FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_KINDS = inputs.pick("c_custkey", "n_name", "n_name", "'nowhere ' || n_name", "NULL")
_LANDS = inputs.pick("c_custkey", "r_name", "r_name", "'Atlantis'")
_SEGS = "CASE WHEN c_custkey % 11 = 0 THEN 'UNKNOWN' ELSE c_mktsegment END"


def _priced(t):
    rows = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey"))
    ref = rows.selectExpr("n_name AS city", "r_name AS country", "c_mktsegment AS activity", "c_acctbal AS price")
    todo = rows.selectExpr("c_custkey", f"{_KINDS} AS city", f"{_LANDS} AS country", f"{_SEGS} AS activity", "CASE WHEN c_acctbal > 0 THEN c_acctbal END AS price")
    return todo, ref


@query("agg4_price_ladder", f"""
WITH ref AS (SELECT * FROM ({_CUST}) WHERE price > 0), todo AS (SELECT c_custkey, {_KINDS} AS city, {_LANDS} AS country, {_SEGS} AS activity, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS price
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
m1 AS (SELECT city, activity, median(price) AS m FROM ref GROUP BY 1, 2), m2 AS (SELECT country, activity, median(price) AS m FROM ref GROUP BY 1, 2), m3 AS (SELECT activity, median(price) AS m FROM ref GROUP BY 1)
SELECT c_custkey, round(coalesce(price, m1.m, m2.m, m3.m), 3) AS price, price IS NULL AS price_is_estimated,
 CASE WHEN price IS NOT NULL THEN 0 WHEN m1.m IS NOT NULL THEN 1 WHEN m2.m IS NOT NULL THEN 2 WHEN m3.m IS NOT NULL THEN 3 END AS price_level
FROM todo LEFT JOIN m1 ON lower(todo.city) = lower(m1.city) AND todo.activity = m1.activity LEFT JOIN m2 ON lower(todo.country) = lower(m2.country) AND todo.activity = m2.activity LEFT JOIN m3 ON todo.activity = m3.activity""")
def _(t):
    todo, ref = _priced(t)
    return impute.fill_prices(todo, ref, digits=3).select("c_custkey", "price", "price_is_estimated", "price_level")


@query("agg4_exact_median", """
SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS median FROM lineitem GROUP BY 1, 2""")
def _(t):
    return impute.exact_median(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query("agg5_language_pivot", """
SELECT l_orderkey, coalesce(max(CASE WHEN l_returnflag = 'R' THEN 'text ' || CAST(l_linenumber AS STRING) END), max(CASE WHEN l_returnflag = 'N' THEN 'text ' || CAST(l_linenumber AS STRING) END), max('text ' || CAST(l_linenumber AS STRING)), '') AS detail FROM lineitem GROUP BY l_orderkey""")
def _(t):
    rows = t.lineitem.withColumn("text", F.concat(F.lit("text "), c("l_linenumber").cast("string")))
    return reports.language_text(rows, "l_orderkey", "l_returnflag", ["R", "N"], "text", "detail")


@query("agg5_distinct_list", """
SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ' | ' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey""")
def _(t):
    return reports.distinct_list(t.orders, "o_custkey", "o_orderpriority", "priorities")


@query("agg6_product_lists", """
SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS themes, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS languages FROM lineitem GROUP BY l_partkey""")
def _(t):
    themes = reports.distinct_array(t.lineitem, "l_partkey", "l_linenumber", "themes")
    langs = reports.distinct_array(t.lineitem, "l_partkey", "l_returnflag", "languages")
    return themes.join(langs, "l_partkey").select(
        "l_partkey", F.array_join(F.transform("themes", lambda x: x.cast("string")), ",").alias("themes"), F.array_join("languages", ",").alias("languages"))


@query("agg7_pivot", f"""
WITH {inputs.CATALOG_SQL} SELECT country, round(avg(price) FILTER (WHERE activity = 'EXCURSION'), 6) AS EXCURSION, round(avg(price) FILTER (WHERE activity = 'TICKET'), 6) AS TICKET,
 round(avg(price) FILTER (WHERE activity = 'TRANSFER'), 6) AS TRANSFER FROM catalog GROUP BY country""")
def _(t):
    return reports.pivot_measures(inputs.catalog(t), ["country"], "activity", ["EXCURSION", "TICKET", "TRANSFER"], F.round(F.avg("price"), 6), "price")


@query("agg7_destination_pivot", f"""
WITH {inputs.CATALOG_SQL} SELECT country, city, {', '.join(f"round(avg(price) FILTER (WHERE category = '{k}'), 6) AS {k}" for k in ('CULTURAL', 'NATURE', 'FOOD'))} FROM catalog GROUP BY country, city""")
def _(t):
    return reports.pivot_measures(inputs.catalog(t), ["country", "city"], "category", ["CULTURAL", "NATURE", "FOOD"], F.round(F.avg("price"), 6), "price")


@query("agg7_zone_pivot", f"""
WITH {inputs.SUPPLIERS_SQL} SELECT n_regionkey AS zone_id, {', '.join(f"round(avg(score) FILTER (WHERE connection = '{k}'), 6) AS {k}_score, sum(score) FILTER (WHERE connection = '{k}')::BIGINT AS {k}_products" for k in ('API', 'CHANNEL', 'BOTH', 'NONE'))}
FROM suppliers JOIN nation ON country_id = n_nationkey GROUP BY n_regionkey""")
def _(t):
    rows = inputs.suppliers(t).join(t.nation, c("country_id") == c("n_nationkey")).withColumnRenamed("n_regionkey", "zone_id")
    return rows.groupBy("zone_id").pivot("connection", ["API", "CHANNEL", "BOTH", "NONE"]).agg(
        F.round(F.avg("score"), 6).alias("score"), F.sum("score").alias("products"))


_TOOLS = """tools AS (SELECT event_type AS tool, CASE WHEN value < 20 THEN 'error' WHEN value < 50 THEN 'no_products' ELSE 'ok' END AS status, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(user_id AS INTEGER) END AS fetch_ms,
 CAST(json_extract_string(props, '$.k') AS INTEGER) AS tokens FROM events)"""


@query("agg8_tool_summary", f"""
WITH {_TOOLS} SELECT tool, count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'no_products') AS no_products, count(*) FILTER (WHERE status = 'error') AS errors,
 avg(coalesce(fetch_ms, 0)) AS avg_fetch_ms, avg(coalesce(tokens, 0)) AS avg_tokens FROM tools GROUP BY tool""")
def _(t):
    rows = t.events.selectExpr("event_type AS tool", "CASE WHEN value < 20 THEN 'error' WHEN value < 50 THEN 'no_products' ELSE 'ok' END AS status",
                               "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(user_id AS INT) END AS fetch_ms", "CAST(get_json_object(props, '$.k') AS INT) AS tokens")
    return reports.tool_summary(rows)


_FOUND = """found AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'maps' ELSE 'local' END AS source, CASE o_orderstatus WHEN 'F' THEN 'API' WHEN 'O' THEN 'CHANNEL' ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'BOTH' ELSE 'NONE' END END AS connection,
 CAST(o_totalprice / 10000 AS INTEGER) AS score, CAST(o_totalprice / 100 AS INTEGER) AS fetch_ms, n_name AS country FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _found(t):
    rows = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey"))
    return rows.selectExpr("CASE WHEN o_orderkey % 2 = 0 THEN 'maps' ELSE 'local' END AS source",
                           "CASE o_orderstatus WHEN 'F' THEN 'API' WHEN 'O' THEN 'CHANNEL' ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'BOTH' ELSE 'NONE' END END AS connection",
                           "CAST(floor(o_totalprice / 10000) AS INT) AS score", "CAST(floor(o_totalprice / 100) AS INT) AS fetch_ms", "n_name AS country")


@query("agg9_source_summary", f"""
WITH {_FOUND.replace("CAST(o_totalprice / 10000", "CAST(floor(o_totalprice / 10000)").replace("CAST(o_totalprice / 100 ", "CAST(floor(o_totalprice / 100) ")} SELECT source, count(*) AS total, count(*) FILTER (WHERE connection = 'API') AS api_only, count(*) FILTER (WHERE connection = 'CHANNEL') AS channel_only, count(*) FILTER (WHERE connection = 'BOTH') AS both,
 round(avg(score), 1) AS avg_score, round(avg(fetch_ms)) AS avg_fetch_ms, count(DISTINCT country) AS countries FROM found GROUP BY source""")
def _(t):
    return reports.source_summary(_found(t))


@query("agg9_source_by_country", f"""
WITH {_FOUND.replace("CAST(o_totalprice / 10000", "CAST(floor(o_totalprice / 10000)").replace("CAST(o_totalprice / 100 ", "CAST(floor(o_totalprice / 100) ")} SELECT country, source, count(*) AS total, count(*) FILTER (WHERE connection <> 'NONE') AS qualified, round(avg(score), 1) AS avg_score FROM found GROUP BY country, source""")
def _(t):
    return reports.source_by_country(_found(t))


@query("agg11_type_breakdown", f"""
WITH {inputs.RAW_SQL}, x AS (SELECT supplier_id, {case_words("lower(title || ' ' || description || ' ' || category_raw)", vocab.STAGE_ACTIVITY_RULES, 'EXCURSION')} AS activity FROM raw),
n AS (SELECT supplier_id, activity, count(*) AS n FROM x GROUP BY 1, 2) SELECT supplier_id, CAST(sum(n) AS BIGINT) AS products, string_agg(activity || 'x' || CAST(n AS STRING), ' ' ORDER BY activity) AS types FROM n GROUP BY 1""")
def _(t):
    rows = inputs.raw(t).withColumn("activity", normalise.activity_of(c("title"), c("description"), c("category_raw")))
    out = reports.type_breakdown(rows, "supplier_id", "activity")
    pills = F.transform(F.map_entries("types"), lambda e: F.concat(e["key"], F.lit("x"), e["value"].cast("string")))
    return out.select("supplier_id", "products", F.array_join(pills, " ").alias("types"))


@query("agg11_tool_share", f"""
WITH {inputs.RAW_SQL} SELECT 'firecrawl' AS part, count(*) FILTER (WHERE contains(source, 'firecrawl')) AS n, round(CAST(count(*) FILTER (WHERE contains(source, 'firecrawl')) AS DOUBLE) / count(*), 4) AS share FROM raw
UNION ALL SELECT 'jsonld', count(*) FILTER (WHERE contains(source, 'jsonld')), round(CAST(count(*) FILTER (WHERE contains(source, 'jsonld')) AS DOUBLE) / count(*), 4) FROM raw""")
def _(t):
    return reports.shares(inputs.raw(t), {k: F.contains("source", F.lit(k)) for k in ("firecrawl", "jsonld")})


@query("agg12_connection_mix", f"""
WITH {inputs.SUPPLIERS_SQL} SELECT count(*) FILTER (WHERE domain IS NOT NULL) AS with_domain, count(*) FILTER (WHERE has_channel) AS channel, count(*) FILTER (WHERE has_api) AS api,
 count(*) FILTER (WHERE connection = 'NONE') AS none_ FROM suppliers""")
def _(t):
    return reports.condition_counts(inputs.suppliers(t), {"with_domain": c("domain").isNotNull(), "channel": c("has_channel"), "api": c("has_api"), "none_": c("connection") == "NONE"})


@query("agg12_channel_counts", f"WITH {inputs.SUPPLIERS_SQL} SELECT channel_name, count(*) AS n FROM suppliers WHERE channel_name IS NOT NULL GROUP BY 1")
def _(t):
    return reports.top_counts(inputs.suppliers(t).where("channel_name is not null"), ["channel_name"])


@query("agg13_run_counters", f"""
WITH {inputs.RAW_SQL}, x AS (SELECT run_id, CASE WHEN title IN ('Safari') OR length(title) < 8 OR regexp_matches(lower(title), '^top [0-9]+') THEN 'rejected' WHEN price IS NULL THEN 'skipped' ELSE 'saved' END AS disposition FROM raw)
SELECT run_id, count(*) AS extracted, count(*) FILTER (WHERE disposition = 'saved') AS saved, count(*) FILTER (WHERE disposition = 'skipped') AS skipped, count(*) FILTER (WHERE disposition = 'rejected') AS rejected,
 count(*) FILTER (WHERE disposition = 'error') AS error FROM x GROUP BY run_id""")
def _(t):
    rows = normalise.gate_products(inputs.raw(t)).withColumn("disposition", F.when(c("reject_reason").isNotNull(), "rejected").when(c("price").isNull(), "skipped").otherwise("saved"))
    return reports.disposition_counts(rows, "run_id")


@query("agg14_city_pages", f"""
WITH {inputs.CATALOG_SQL} SELECT city, count(*) FILTER (WHERE activity IN ('EXCURSION', 'TICKET')) AS excursions, count(*) FILTER (WHERE activity = 'TRANSFER') AS transfers FROM catalog GROUP BY city""")
def _(t):
    return reports.condition_counts(inputs.catalog(t), {"excursions": c("activity").isin("EXCURSION", "TICKET"), "transfers": c("activity") == "TRANSFER"}, ["city"])


# --- rankings ---------------------------------------------------------------------------------
@query("top2_interval_cut", f"""
WITH {inputs.SUPPLIERS_SQL} SELECT country_id, supplier_id, score, CAST(row_number() OVER (PARTITION BY country_id ORDER BY score DESC, supplier_id) AS INTEGER) AS rank FROM suppliers WHERE has_api OR has_channel QUALIFY rank <= 2""")
def _(t):
    chosen, _report = reports.interval_cut(inputs.suppliers(t), 1, 2, country="country_id")
    return chosen.select("country_id", "supplier_id", "score", "rank")


@query("top2_shortfall", f"""
WITH {inputs.SUPPLIERS_SQL} SELECT country_id, count(*) AS reachable, count(*) FILTER (WHERE has_api OR has_channel) AS connected, least(count(*) FILTER (WHERE has_api OR has_channel), 3) AS kept,
 least(count(*) FILTER (WHERE has_api OR has_channel), 3) < 2 AS shortfall FROM suppliers GROUP BY country_id""")
def _(t):
    return reports.interval_cut(inputs.suppliers(t), 2, 3, country="country_id")[1]


@query("top3_distinct_titles", f"""
WITH {inputs.RAW_SQL}, f AS (SELECT supplier_id, title, min(product_id) AS product_id FROM raw GROUP BY 1, 2)
SELECT supplier_id, title, product_id, CAST(row_number() OVER (PARTITION BY supplier_id ORDER BY product_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 20""")
def _(t):
    return reports.distinct_titles(inputs.raw(t), "supplier_id", "title", "product_id", 20)


@query("top4_first_by_position", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1")
def _(t):
    order = [F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")]
    return reports.top_per_group(t.lineitem, ["l_orderkey"], order, 1).select("l_orderkey", "l_partkey", "l_suppkey")


@query("top5_newest_priced", f"WITH {inputs.MATCHES_SQL} SELECT match_id, price FROM matches WHERE price > 0 ORDER BY created_at DESC, match_id LIMIT 9")
def _(t):
    return inputs.matches(t).where("price > 0").orderBy(F.desc("created_at"), "match_id").select("match_id", "price").limit(9)


# --- queues and joins -------------------------------------------------------------------------
_PROD = "prods AS (SELECT o_orderkey AS product_id, 'Order ' || CAST(o_orderkey AS STRING) AS title, o_orderkey % 13 AS supplier_id FROM orders)"


def _products(t):
    return t.orders.selectExpr("o_orderkey AS product_id", "'Order ' || CAST(o_orderkey AS STRING) AS title", "o_orderkey % 13 AS supplier_id")


@query("jn12_review_queue", f"""
WITH {inputs.MATCHES_SQL}, {_PROD}, {inputs.SUPPLIERS_SQL} SELECT match_id, title, name AS supplier_name, domain FROM matches JOIN prods USING (product_id) LEFT JOIN suppliers USING (supplier_id)
WHERE match_status = 'NEW_PRODUCT' AND validation_decision IS NULL ORDER BY created_at DESC, match_id DESC""")
def _(t):
    sup = inputs.suppliers(t).select("supplier_id", "name", "domain")
    return reports.review_queue(inputs.matches(t), _products(t), sup).select("match_id", "title", c("name").alias("supplier_name"), "domain")


@query("jn13_export_queue", f"""
WITH {inputs.MATCHES_SQL}, {_PROD}, {inputs.SUPPLIERS_SQL}, r AS (SELECT l_orderkey AS product_id, arg_min(l_partkey, l_linenumber * 100000000 + l_partkey) AS part FROM lineitem GROUP BY 1)
SELECT match_id, product_id, title, part, name FROM prods JOIN matches USING (product_id) LEFT JOIN r USING (product_id) LEFT JOIN suppliers USING (supplier_id) WHERE match_status = 'ACCEPTED' AND external_id IS NULL""")
def _(t):
    raw = t.lineitem.groupBy(c("l_orderkey").alias("product_id")).agg(F.min_by("l_partkey", c("l_linenumber") * 100000000 + c("l_partkey")).alias("part"))
    return reports.export_queue(inputs.matches(t), _products(t), raw, inputs.suppliers(t).select("supplier_id", "name")).select("match_id", "product_id", "title", "part", "name")


@query("jn14_flatten_catalogue", """
WITH d AS (SELECT l_orderkey AS product_id, coalesce(max(CASE WHEN l_linenumber = 2 THEN 'text ' || CAST(l_partkey AS STRING) END), max(CASE WHEN l_linenumber = 1 THEN 'text ' || CAST(l_partkey AS STRING) END), max('text ' || CAST(l_partkey AS STRING))) AS detail_text FROM lineitem GROUP BY 1),
th AS (SELECT l_orderkey AS product_id, string_agg(DISTINCT p_type, ' | ' ORDER BY p_type) AS themes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT o_orderkey AS product_id, c_name AS city_name, coalesce(detail_text, '') AS detail_text, themes FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN d ON o_orderkey = d.product_id LEFT JOIN th ON o_orderkey = th.product_id""")
def _(t):
    products = t.orders.select(c("o_orderkey").alias("product_id"), c("o_custkey").alias("locality_id"))
    localities = t.customer.select(c("c_custkey").alias("locality_id"), c("c_name").alias("city_name"))
    details = t.lineitem.select(c("l_orderkey").alias("product_id"), c("l_linenumber").alias("language_id"), F.concat(F.lit("text "), c("l_partkey").cast("string")).alias("text"))
    links = t.lineitem.select(c("l_orderkey").alias("product_id"), c("l_partkey").alias("theme_id"))
    themes = t.part.select(c("p_partkey").alias("theme_id"), c("p_type").alias("theme"))
    return normalise.flatten_catalogue(products, localities, details, links, themes).select("product_id", "city_name", "detail_text", "themes")


@query("jn15_locality_roles", """
SELECT o_orderkey, a.n_name AS city, b.n_name AS departure, d.n_name AS arrival, coalesce(nullif(b.n_name, '') || ' → ' || d.n_name, '') AS route FROM orders LEFT JOIN nation a ON a.n_nationkey = o_custkey % 30
LEFT JOIN nation b ON b.n_nationkey = o_orderkey % 30 LEFT JOIN nation d ON d.n_nationkey = (o_orderkey + 7) % 30""")
def _(t):
    loc = lambda key, name: t.nation.select(c("n_nationkey").alias(key), c("n_name").alias(name))
    o = t.orders.selectExpr("o_orderkey", "CAST(o_custkey % 30 AS INT) AS k1", "CAST(o_orderkey % 30 AS INT) AS k2", "CAST((o_orderkey + 7) % 30 AS INT) AS k3")
    out = o.join(loc("k1", "city"), "k1", "left").join(loc("k2", "departure"), "k2", "left").join(loc("k3", "arrival"), "k3", "left")
    return out.select("o_orderkey", "city", "departure", "arrival", F.coalesce(F.concat("departure", F.lit(" → "), "arrival"), F.lit("")).alias("route"))


@query("jn16_connected_by_country", f"""
WITH {inputs.SUPPLIERS_SQL} SELECT supplier_id, name, score, n_name AS country FROM suppliers JOIN nation ON country_id = n_nationkey WHERE connection <> 'NONE' AND coalesce(domain, '') <> '' ORDER BY score DESC, supplier_id""")
def _(t):
    rows = inputs.suppliers(t).where("connection <> 'NONE' AND coalesce(domain, '') <> ''").join(t.nation, c("country_id") == c("n_nationkey"))
    return rows.select("supplier_id", "name", "score", c("n_name").alias("country")).orderBy(F.desc("score"), "supplier_id")


@query("jn21_missing_prices", f"""
WITH {inputs.MATCHES_SQL}, {inputs.RAW_SQL} SELECT raw.product_id, title FROM raw JOIN matches USING (product_id) WHERE match_status = 'ACCEPTED' AND (raw.price IS NULL OR raw.price = 0)""")
def _(t):
    accepted = inputs.matches(t).where("match_status = 'ACCEPTED'").select("product_id")
    return inputs.raw(t).where("price IS NULL OR price = 0").join(accepted, "product_id").select("product_id", "title")


# --- dedup ------------------------------------------------------------------------------------
#: Row by row in the order of seq: ``rows`` (seq, ok, url, name) against the lists of what is known.
_IN_ORDER = """
numbered AS (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM rows),
replay(i, seq, disposition, urls, names) AS (
 SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), (SELECT list(url) FROM known WHERE url IS NOT NULL), (SELECT list(name) FROM known WHERE name IS NOT NULL)
 UNION ALL
 SELECT n.i, n.seq, CASE WHEN NOT ok THEN 'rejected' WHEN seen THEN 'skipped' ELSE 'saved' END,
  CASE WHEN ok AND NOT seen AND url IS NOT NULL THEN list_append(urls, url) ELSE urls END, CASE WHEN ok AND NOT seen AND name IS NOT NULL THEN list_append(names, name) ELSE names END
 FROM (SELECT d.*, r.urls, r.names, coalesce(list_contains(r.urls, d.url), false) OR coalesce(list_contains(r.names, d.name), false) AS seen FROM replay r JOIN numbered d ON d.i = r.i + 1) n)"""
_SLUG = sql_squeeze(sql_replace("strip_accents(lower(trim(text)))", r"[^a-z0-9\s]", "' '"))


@query("set1_batch_dedup", f"""
WITH RECURSIVE rows AS (SELECT doc_id AS seq, coalesce(length(text) >= 8, false) AS ok, md5(text) AS url, md5({_SLUG}) || '|' || coalesce(source, '') AS name FROM documents),
known AS (SELECT md5(text) AS url, md5({_SLUG}) || '|src0' AS name FROM benchmark), {_IN_ORDER}
SELECT seq AS doc_id, disposition FROM replay WHERE seq IS NOT NULL""")
def _(t):
    # Exact copies share the URL, texts equal but for case and punctuation share the name within a source.
    docs = t.documents.select("doc_id", F.md5("text").alias("url"), F.md5(slug_text(c("text"))).alias("name"), "source", F.length("text").alias("n"))
    known = t.benchmark.select(F.md5("text").alias("url"), F.md5(slug_text(c("text"))).alias("name"), F.lit("src0").alias("source"))
    return dedup.accept_in_order(docs, known, "doc_id", "url", "name", "source", valid=c("n") >= 8).select("doc_id", "disposition")


@query("set1_single_key_dedup", """
WITH d AS (SELECT doc_id, md5(text) AS url FROM documents) SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY url ORDER BY doc_id) = 1 THEN 'saved' ELSE 'skipped' END AS disposition FROM d""")
def _(t):
    docs = t.documents.select("doc_id", F.md5("text").alias("url"), c("doc_id").cast("string").alias("name"), "source")
    return dedup.accept_in_order(docs, docs.where(F.lit(False)), "doc_id", "url", "name", "source").select("doc_id", "disposition")


@query("set2_merge_suppliers", f"""
WITH RECURSIVE {inputs.SUPPLIERS_SQL}, e AS (SELECT domain, name, country_id, score FROM suppliers), i AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 2 = 0 THEN 'shop' || CAST(c_custkey % 150 AS STRING) || '.example.com' ELSE 'new' || CAST(c_custkey % 400 AS STRING) || '.example.com' END AS domain,
 CASE WHEN c_custkey % 3 = 0 THEN 'Supplier#' || lpad(CAST(c_custkey % 100 AS STRING), 9, '0') ELSE c_name END AS name, c_nationkey AS country_id, CAST(c_custkey % 120 AS INTEGER) AS score FROM customer),
rows AS (SELECT seq, true AS ok, domain AS url, name || '|' || CAST(country_id AS VARCHAR) AS name FROM i), known AS (SELECT domain AS url, name || '|' || CAST(country_id AS VARCHAR) AS name FROM e), {_IN_ORDER},
f AS (SELECT i.* FROM i JOIN replay USING (seq) WHERE disposition = 'saved'), b AS (SELECT domain, max(score) AS best FROM i GROUP BY domain)
SELECT e.domain, e.name, e.country_id, greatest(e.score, coalesce(best, 0)) AS score FROM e LEFT JOIN b USING (domain)
UNION ALL SELECT f.domain, f.name, f.country_id, (SELECT max(x.score) FROM i x WHERE x.domain = f.domain AND x.seq >= f.seq) FROM f""")
def _(t):
    e = inputs.suppliers(t).select("domain", "name", "country_id", "score")
    i = t.customer.selectExpr("c_custkey AS seq", "CASE WHEN c_custkey % 2 = 0 THEN 'shop' || CAST(c_custkey % 150 AS STRING) || '.example.com' ELSE 'new' || CAST(c_custkey % 400 AS STRING) || '.example.com' END AS domain",
                              "CASE WHEN c_custkey % 3 = 0 THEN 'Supplier#' || lpad(CAST(c_custkey % 100 AS STRING), 9, '0') ELSE c_name END AS name", "c_nationkey AS country_id", "CAST(c_custkey % 120 AS INT) AS score")
    return dedup.merge_suppliers(e, i)


@query("set3_keep_latest", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def _(t):
    return dedup.keep_latest(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query("set4_new_hosts", f"""
SELECT DISTINCT {_host} AS host FROM pages WHERE {_host} NOT IN (SELECT 'www' || CAST(s_suppkey AS STRING) FROM supplier) UNION SELECT 'shop' || CAST(s_suppkey AS STRING) || '.example.com' FROM supplier""")
def _(t):
    known = t.supplier.select(F.concat(F.lit("www"), c("s_suppkey").cast("string")).alias("host"))
    both = t.pages.select(host(c("url")).alias("host")).unionByName(inputs.suppliers(t).select(c("domain").alias("host")))
    return both.join(known, "host", "left_anti").dropDuplicates(["host"])


@query("set5_split_exported", f"""
WITH {inputs.RAW_SQL}, x AS (SELECT p_partkey AS exported_id, 'Safari' AS name, CASE WHEN p_partkey % 2 = 0 THEN 'run-2' ELSE 'run-9' END AS run_id, p_partkey % 3 = 0 AS automatic FROM part)
SELECT product_id, (SELECT min(exported_id) FROM x WHERE x.name = raw.title AND x.run_id = raw.run_id AND automatic) AS external_id,
 CASE WHEN (SELECT min(exported_id) FROM x WHERE x.name = raw.title AND x.run_id = raw.run_id AND automatic) IS NULL THEN 'insert' ELSE 'skip' END AS action FROM raw""")
def _(t):
    exported = t.part.selectExpr("p_partkey AS exported_id", "'Safari' AS name", "CASE WHEN p_partkey % 2 = 0 THEN 'run-2' ELSE 'run-9' END AS run_id", "p_partkey % 3 = 0 AS automatic")
    return dedup.split_exported(inputs.raw(t).withColumnRenamed("title", "name"), exported).select("product_id", "external_id", "action")


@query("set5_new_suppliers", f"""
WITH {inputs.SUPPLIERS_SQL}, x AS (SELECT s_name AS name, 'https://shop' || CAST(s_suppkey AS STRING) || '.example.com/a' AS website FROM supplier WHERE s_acctbal > 5000)
SELECT supplier_id, name FROM suppliers s WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.name = s.name AND contains(lower(x.website), lower(s.domain)))""")
def _(t):
    exported = t.supplier.where("s_acctbal > 5000").selectExpr("s_name AS name", "'https://shop' || CAST(s_suppkey AS STRING) || '.example.com/a' AS website", "'run' AS run_id")
    return dedup.new_suppliers(inputs.suppliers(t), exported).select("supplier_id", "name")


# --- updates ----------------------------------------------------------------------------------
@query("upd1_apply_updates", f"""
WITH {inputs.MATCHES_SQL}, ch AS (SELECT l_orderkey AS match_id, max(CASE WHEN l_returnflag = 'R' THEN 'REJECTED' WHEN l_returnflag = 'A' THEN 'APPROVED' END) AS validation_decision, max(l_partkey) AS external_id FROM lineitem GROUP BY 1)
SELECT m.match_id, coalesce(ch.validation_decision, m.validation_decision) AS validation_decision, coalesce(ch.external_id, m.external_id) AS external_id, m.price FROM matches m LEFT JOIN ch USING (match_id)""")
def _(t):
    changes = t.lineitem.groupBy(c("l_orderkey").alias("match_id")).agg(
        F.max(F.when(c("l_returnflag") == "R", "REJECTED").when(c("l_returnflag") == "A", "APPROVED")).alias("validation_decision"), F.max("l_partkey").alias("external_id"))
    base = inputs.matches(t).select("match_id", "validation_decision", "external_id", "price")
    return upsert.apply_updates(base, changes, ["match_id"], ["validation_decision", "external_id"])


def _new_products(t):
    cat = inputs.catalog(t)
    return cat.select(c("catalog_id").cast("string").alias("product_key"), c("name").alias("title"), "description", F.lower("activity").alias("type_label"),
                      first_label(F.lower("activity"), [(["ticket"], "449"), (["transfer"], "3")], "2").alias("type_code"), "category", F.lit(1).alias("locality_id"), "price",
                      F.lit(None).cast("string").alias("currency"), F.lit(None).cast("string").alias("operator"), "city", "country")


@query("upd2_catalogue_rows", f"""
WITH {inputs.CATALOG_SQL} SELECT name, city || ', ' || country AS address, {case_equal('activity', [('TICKET', '449'), ('TRANSFER', '3')], "'2'")} AS type_code, price, CAST(round(CAST(price AS DECIMAL(14,2)) * CAST(0.85 AS DECIMAL(4,2)), 2) AS DOUBLE) AS purchase_price, 'EUR' AS currency,
 'Scraped Supplier' AS operator, 2 AS n_details, 1 AS n_services FROM catalog""")
def _(t):
    made = upsert.catalogue_rows(_new_products(t))
    details = made["detail"].groupBy("product_id").agg(F.count("*").cast("int").alias("n_details"))
    services = made["service"].groupBy("product_id").agg(F.count("*").cast("int").alias("n_services"))
    return made["product"].join(details, "product_id").join(services, "product_id").select(
        "name", "address", "type_code", "price", "purchase_price", "currency", "operator", "n_details", "n_services")


# --- streams ----------------------------------------------------------------------------------
@query("str1_incremental_run", """
SELECT user_id, arg_max(event_id, ts) AS event_id, upper(arg_max(event_type, ts)) AS label FROM events GROUP BY user_id""")
def _(t):
    table, checkpoint = scratch_path(t.spark, "log"), scratch_path(t.spark, "checkpoint")
    arriving = incremental.landing_stream(t.spark, t.folder, t.events.schema, pathGlobFilter="events.parquet")
    run = incremental.incremental_run(arriving, lambda df: df.select("user_id", "event_id", F.upper("event_type").alias("label")), ["user_id"], "ts", table, checkpoint)
    run.awaitTermination()
    return upsert.read_log(t.spark, table, ["user_id"])


@query("str2_dedup_stream", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    table, checkpoint = scratch_path(t.spark, "dedup"), scratch_path(t.spark, "checkpoint")
    arriving = incremental.landing_stream(t.spark, t.folder, t.events.schema, pathGlobFilter="events.parquet")
    run = incremental.append_stream(incremental.dedup_stream(arriving, ["user_id", "event_type"], "ts", watermark="60 days"), table, checkpoint)
    run.awaitTermination()
    return t.spark.read.parquet(table).select("user_id", "event_type")
