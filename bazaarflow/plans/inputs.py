"""Supplier, catalogue and gazetteer tables derived from the test tables.

Each derivation is a list of (column, expression); the expressions are plain SQL that both engines read, so a
query and its oracle start from the same rows. They keep every row of the table they come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarflow.plans.registry import Tables
from bazaarflow.session import spread


def pick(number: str, *choices: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices))
    return f"CASE {number} % {len(choices)} {arms} END"


def money(expr: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(12,2)) AS STRING)"


# Whole cents, so that both engines get the same number.
PRICE = "floor(CAST(round(p_retailprice * 100) AS BIGINT) * p_size / 40) / 100"
RAW = [
    ("product_id", "p_partkey"), ("supplier_id", "p_partkey % 10"), ("run_id", "'run-' || CAST(p_size % 4 AS STRING)"),
    ("title", pick("p_size",
                   "'Private Airport Transfer from Fiumicino to Rome - ' || p_name",
                   "'Skip the Line Museum Ticket Paris 2024 ' || p_name || ' | Viator'",
                   "'Whale Watching Boat Cruise in Lofoten (' || p_name || ')'",
                   "'Desert Safari and Quad Adventure Marrakech ' || p_name",
                   "'Wine Tasting and Cooking Class in Florence'", "'Half Day City Walking Tour of Stockholm ' || p_name",
                   "'Golf Course Experience in Lisbon ' || p_brand", "'Hammam and Spa Relax Day in Tunis ' || p_name",
                   "'Departure Transfer Paris Hotel to CDG Airport'", "'Top 10 things to do in 2024'", "'Safari'",
                   "'Family Zoo and Theme Park Pass Berlin ' || p_name")),
    ("title_en", "CAST(NULL AS STRING)"),
    ("description", "'<p>Enjoy the ' || p_name || ' with guide &amp; lunch.</p><script>var x = 1;</script> ' || "
     + pick("p_partkey", "'Small group of locals, guided by experts in the area. Duration 3 hours.'",
            "'Free cancellation up to one day ahead.'", "'A shared bus picks you up at the hotel, 45 min away. From €' || "
            + money("p_retailprice / 10") + " || ' per person.'", "'Price $' || CAST(p_size AS STRING) || ' only. Boat and lunch included in the fare.'",
            "'Food, wine and history: a visit for 2 days.'") + " || ' Book now and save.'"),
    ("description_en", "CAST(NULL AS STRING)"),
    ("price", f"CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 11 = 0 THEN 9000.0 ELSE {PRICE} END"),
    ("currency", pick("p_partkey", "'EUR'", "'usd'", "'GBP '", "'TND'", "'XYZ'", "NULL")),
    ("duration", pick("p_partkey", "'3 hours'", "'45 min'", "'2 days'", "'1.5 h'", "'1h 30min'", "'soon'", "NULL")),
    ("category_raw", "lower(p_type)"),
    ("city_raw", pick("p_size", "upper(p_name)", "'tours'", "NULL", "replace(p_name, 'l', 'll')", "p_name || ' museum'", "''",
                      "p_name", "'one two three four five'")),
    ("country_raw", pick("p_partkey", "'NATION_' || CAST(p_size % 25 AS STRING)", "' nation_' || CAST(p_size % 25 AS STRING)",
                         "'Atlantis'", "''", "NULL", "'United States'")),
    ("url", "'https://www.shop' || CAST(p_partkey % 10 AS STRING) || '.example.com/' || "
     + pick("p_size", "'tours/'", "'tickets/'", "'blog/'", "'italy/excursions/'", "'img/'", "'activities/'", "'fr/guide/'")
     + " || replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS STRING) || "
     + pick("p_partkey", "'/'", "'.html'", "'.jpg'", "'?page=2'")),
    ("source", pick("p_partkey", "'jsonld'", "'bs4'", "'firecrawl_groq'", "'manual'")),
]
CITIES = [("city_id", "min(p_partkey)"), ("name", "p_name"), ("country", "'NATION_' || CAST(p_partkey % 25 AS STRING)"),
          ("lat", "CAST(min(p_size) AS DOUBLE)"), ("lng", "CAST(max(p_size) AS DOUBLE)")]
CATALOG = [
    ("catalog_id", "p_partkey"), ("name", pick("p_size", "'Rome Airport Transfer ' || p_name", "'Paris museum ticket ' || p_name",
                                              "'Boat cruise ' || p_name", "p_name || ' tour'")),
    ("name_en", "CASE WHEN p_partkey % 3 = 0 THEN 'Private ' || p_name || ' Tour' END"),
    ("description", "'A ' || p_name || ' visit with guide and lunch for the whole ' || lower(p_type) || ' group.'"),
    ("city", pick("p_partkey", "'Rome'", "'Paris'", "'Tunis'", "'Oslo'", "'Berlin'", "'Cairo'")),
    ("country", pick("p_partkey", "'Italy'", "'France'", "'Tunisia'")),
    ("activity", pick("p_partkey", "'EXCURSION'", "'TICKET'", "'TRANSFER'", "'EXCURSION'")),
    ("category", pick("p_partkey", "'CULTURAL'", "'NATURE'", "'Transfer'", "'FOOD'", "NULL")),
    ("price", f"CASE WHEN p_size % 9 = 0 THEN NULL ELSE {PRICE} END"),
]


def select(columns) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns)


RAW_SQL = f"raw AS (SELECT {select(RAW)} FROM part)"
CITIES_SQL = f"cities AS (SELECT {select(CITIES)} FROM part GROUP BY p_name, p_partkey % 25)"
COUNTRIES_SQL = "countries AS (SELECT n_nationkey AS country_id, n_name AS country, n_regionkey AS zone_id FROM nation)"
CATALOG_SQL = f"catalog AS (SELECT {select(CATALOG)} FROM part)"
SUPPLIERS = [("supplier_id", "s_suppkey"), ("name", "s_name"), ("domain", "'shop' || CAST(s_suppkey AS STRING) || '.example.com'"),
             ("country_id", "s_nationkey"), ("score", "CAST(floor(abs(s_acctbal) / 100) AS INTEGER)"),
             ("run_id", "'run-' || CAST(s_suppkey % 4 AS STRING)"), ("has_api", "s_suppkey % 3 = 0"), ("has_channel", "s_suppkey % 4 = 1"),
             ("channel_name", "CASE WHEN s_suppkey % 4 = 1 THEN 'Bokun' END"),
             ("connection", "CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 = 1 THEN 'BOTH' WHEN s_suppkey % 3 = 0 THEN 'API' "
                            "WHEN s_suppkey % 4 = 1 THEN 'CHANNEL' ELSE 'NONE' END")]
SUPPLIERS_SQL = f"suppliers AS (SELECT {select(SUPPLIERS)} FROM supplier)"
# Review states from the order table: one match per order.
MATCHES = [("match_id", "o_orderkey"), ("product_id", "o_orderkey"), ("customer_id", "o_custkey"),
           ("match_status", "CASE o_orderstatus WHEN 'F' THEN 'ACCEPTED' WHEN 'O' THEN 'NEW_PRODUCT' ELSE 'SIMILAR' END"),
           ("validation_decision", "CASE o_orderpriority WHEN '1-URGENT' THEN 'APPROVED' WHEN '2-HIGH' THEN 'REJECTED' END"),
           ("external_id", "CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN o_orderkey + 1000000 END"),
           ("price", "CASE WHEN o_totalprice < 50000 THEN NULL ELSE o_totalprice END"), ("created_at", "o_orderdate")]
MATCHES_SQL = f"matches AS (SELECT {select(MATCHES)} FROM orders)"


def derive(df: DataFrame, columns) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in columns])


def raw(t: Tables) -> DataFrame:
    return derive(spread(t.part, "p_partkey"), RAW)


def catalog(t: Tables) -> DataFrame:
    return derive(t.part, CATALOG)


def cities(t: Tables) -> DataFrame:
    keyed = t.part.withColumn("_c", F.expr("p_partkey % 25"))
    return keyed.groupBy("p_name", "_c").agg(
        F.min("p_partkey").alias("city_id"), F.min("p_size").cast("double").alias("lat"), F.max("p_size").cast("double").alias("lng")) \
        .select("city_id", F.col("p_name").alias("name"), F.concat(F.lit("NATION_"), F.col("_c").cast("string")).alias("country"), "lat", "lng")


def countries(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("country_id"), F.col("n_name").alias("country"), F.col("n_regionkey").alias("zone_id"))


def suppliers(t: Tables) -> DataFrame:
    return derive(t.supplier, SUPPLIERS)


def matches(t: Tables) -> DataFrame:
    return derive(t.orders, MATCHES)
