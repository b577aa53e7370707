"""Trigram fuzzy join (PostgreSQL definition of trigrams and similarity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarflow import vocab
from bazaarflow.session import materialise


def trigrams(c: Column) -> Column:
    """Set of trigrams: lower-case alphanumeric words, two blanks before and one after each."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def fuzzy_pairs(left: DataFrame, right: DataFrame, threshold: float = vocab.TRIGRAM_MIN, within: str | None = None) -> DataFrame:
    """All (phrase, name) pairs with similarity >= threshold; with ``within``, a column of both sides, only those equal in it.

    Prefix filtering keeps it exact without comparing every pair: with the grams of each string ordered
    rarest first, two strings can only reach the threshold when they share a gram among the first
    size - ceil(threshold * size) + 1 of each. Common grams are hardly ever among these. Nor can they when, at the first
    gram that they share, too few grams follow in either of them.
    """
    scored = _candidates(left, right, threshold, [within] if within else [])
    return (scored.withColumn("score", similarity(trigrams(F.col("phrase")), trigrams(F.col("name"))))
            .where(F.col("score") >= threshold))


def _candidates(left: DataFrame, right: DataFrame, threshold: float, block: list[str]) -> DataFrame:
    """The pairs that fuzzy_pairs compares."""
    def grams(df, col):
        return df.where(F.col(col).isNotNull()).select(col, *block).distinct().withColumn("grams", trigrams(F.col(col))) \
            .where(F.size("grams") > 0)

    a, b = materialise(grams(left, "phrase"), "grams"), materialise(grams(right, "name"), "grams")
    # one order for all blocks, so that both sides of a pair have the same
    counts = (b.select(F.explode("grams").alias("gram")).unionByName(a.select(F.explode("grams").alias("gram")))
              .groupBy("gram").agg(F.count("*").alias("n")))

    def prefixes(df, col, side):
        n = F.size("ordered")
        ordered = (df.select(col, *block, F.explode("grams").alias("gram")).join(counts, "gram")
                   .groupBy(col, *block).agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("ordered")))
        keep = n - F.ceil(n * F.lit(threshold) - 1e-9) + 1
        return ordered.select(col, *block, n.alias(f"size_{side}"), F.posexplode(F.transform(
            F.slice("ordered", F.lit(1), keep.cast("int")), lambda x: x["gram"])).alias(f"pos_{side}", "gram"))

    p, q = prefixes(a, "phrase", "a"), prefixes(b, "name", "b")
    # Sizes alone already bound the similarity by min / max; with positions, at most this many grams are shared.
    close = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(threshold) - 1e-9
    shared = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b"))
    enough = shared >= (F.col("size_a") + F.col("size_b")) * F.lit(threshold / (1 + threshold)) - 1e-9
    return p.join(q, ["gram", *block]).where(close & enough).select("phrase", "name", *block).distinct()


def best_city(phrases: DataFrame, cities: DataFrame, threshold: float = vocab.TRIGRAM_MIN) -> DataFrame:
    """The best gazetteer city for each distinct (phrase, country); a null country means any.

    ``phrases``: phrase, country. ``cities``: city_id, name, country, lat, lng.
    Order: score, then the lowest id. Returns phrase, country, city, city_country, lat, lng, score. A phrase with a country
    meets only the names of that country.
    """
    # '=' and the country; nothing for any country
    block = F.coalesce(F.concat(F.lit("="), F.lower("country")), F.lit("")).alias("_c")
    wanted = materialise(phrases.where(F.length("phrase") >= 2).select("phrase", "country", block).distinct(), "phrases")
    # One row per (name, country) and one per name is enough: the lowest id wins within equal scores.
    row = F.min_by(F.struct("city_id", F.col("country").alias("city_country"), "lat", "lng"), "city_id").alias("r")
    named = cities.where("country is not null").groupBy("name", block).agg(row).unionByName(
        cities.groupBy("name").agg(row).withColumn("_c", F.lit("")))
    named = materialise(named.select("name", "_c", "r.*"), "names")
    scored = fuzzy_pairs(wanted, named, threshold, "_c")
    value = F.struct(F.col("name").alias("city"), "city_country", "lat", "lng")
    best = wanted.join(scored, ["phrase", "_c"]).join(named, ["name", "_c"]).groupBy("phrase", "country").agg(
        F.max_by(F.struct(value.alias("v"), "score"), F.struct("score", -F.col("city_id"))).alias("b"))
    return best.select("phrase", "country", "b.v.*", "b.score")
