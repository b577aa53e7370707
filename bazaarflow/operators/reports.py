"""Counts, pivots, rankings and queues for review and export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def condition_counts(df: DataFrame, conditions: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """One count per named condition, per key or overall, in one pass."""
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def global_counts(tables: Mapping[str, DataFrame], extra: Mapping[str, Mapping[str, Column]] | None = None) -> DataFrame:
    """(metric, value) rows: row count per table, and named condition counts."""
    out = None
    for name, df in tables.items():
        aggs = {name: F.count("*"), **{k: F.count_if(c) for k, c in (extra or {}).get(name, {}).items()}}
        row = df.agg(*[e.alias(k) for k, e in aggs.items()])
        pairs = F.explode(F.create_map(*[x for k in aggs for x in (F.lit(k), F.col(k))])).alias("metric", "value")
        part = row.select(pairs)
        out = part if out is None else out.unionByName(part)
    return out


def top_counts(df: DataFrame, keys: Sequence[str], n: int | None = None) -> DataFrame:
    """Group counts, largest first (then by key); a report cut to ``n`` groups when given."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)
    return out if n is None else out.limit(n)


def pivot_measures(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], measure: Column, name: str) -> DataFrame:
    """Rows × column values of one measure; the column values are given, so no extra pass finds them."""
    return df.groupBy(*rows).pivot(column, list(values)).agg(measure.alias(name))


def source_summary(df: DataFrame) -> DataFrame:
    """Per source: totals, connection mix, mean score and time, countries covered."""
    kind = F.col("connection")
    return df.groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(kind == "API").alias("api_only"),
        F.count_if(kind == "CHANNEL").alias("channel_only"), F.count_if(kind == "BOTH").alias("both"),
        F.round(F.avg("score"), 1).alias("avg_score"), F.round(F.avg("fetch_ms")).alias("avg_fetch_ms"),
        F.count_distinct("country").alias("countries"))


def source_by_country(df: DataFrame) -> DataFrame:
    return df.groupBy("country", "source").agg(
        F.count("*").alias("total"), F.count_if(F.col("connection") != "NONE").alias("qualified"),
        F.round(F.avg("score"), 1).alias("avg_score"))


def tool_summary(df: DataFrame) -> DataFrame:
    """Per tool: rows by status and mean latency and tokens (a missing value counts as 0)."""
    status = F.col("status")
    return df.groupBy("tool").agg(
        F.count("*").alias("total"), F.count_if(status == "ok").alias("ok"),
        F.count_if(status == "no_products").alias("no_products"), F.count_if(status == "error").alias("errors"),
        F.avg(F.coalesce("fetch_ms", F.lit(0))).alias("avg_fetch_ms"), F.avg(F.coalesce("tokens", F.lit(0))).alias("avg_tokens"))


def type_breakdown(df: DataFrame, key: str, type_col: str) -> DataFrame:
    """Per key: number of rows and a map type → count."""
    counts = df.groupBy(key, type_col).agg(F.count("*").alias("_n"))
    return counts.groupBy(key).agg(F.sum("_n").alias("products"), F.map_from_entries(F.array_sort(
        F.collect_list(F.struct(type_col, "_n")))).alias("types"))


def shares(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Count per condition and its share of all rows."""
    row = df.agg(F.count("*").alias("_all"), *[F.count_if(c).alias(k) for k, c in conditions.items()])
    return row.select("_all", F.explode(F.create_map(*[x for k in conditions for x in (F.lit(k), F.col(k))])).alias("part", "n")) \
        .select("part", "n", F.round(F.col("n") / F.col("_all"), 4).alias("share"))


def language_text(df: DataFrame, key: str, language: str, preferred: Sequence, text: str, out: str) -> DataFrame:
    """One text per key: the first preferred language that has one, else any (the greatest)."""
    picks = [F.max(F.when(F.col(language) == p, F.col(text))) for p in preferred]
    return df.groupBy(key).agg(F.coalesce(*picks, F.max(text), F.lit("")).alias(out))


def distinct_list(df: DataFrame, key: str, value: str, out: str, sep: str = " | ") -> DataFrame:
    """Distinct values per key, sorted and joined; duplicates go before values meet in one row."""
    return df.where(F.col(value).isNotNull()).select(key, value).distinct().groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set(value)), sep).alias(out))


def distinct_array(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).select(key, value).distinct().groupBy(key).agg(
        F.array_sort(F.collect_set(value)).alias(out))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per group; the filter on row_number lets Spark cut groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def interval_cut(suppliers: DataFrame, minimum: int, maximum: int, *, country: str = "country", score: str = "score",
                 tie: str = "supplier_id") -> tuple[DataFrame, DataFrame]:
    """The best ``maximum`` connected suppliers per country, and a report of countries below ``minimum``."""
    connected = suppliers.where(F.coalesce(F.col("has_api"), F.lit(False)) | F.coalesce(F.col("has_channel"), F.lit(False)))
    chosen = top_per_group(connected, [country], [F.desc(score), F.asc(tie)], maximum)
    counts = suppliers.groupBy(country).agg(
        F.count("*").alias("reachable"),
        F.count_if(F.coalesce(F.col("has_api"), F.lit(False)) | F.coalesce(F.col("has_channel"), F.lit(False))).alias("connected"))
    report = counts.withColumn("kept", F.least("connected", F.lit(maximum))).withColumn("shortfall", F.col("kept") < minimum)
    return chosen, report


def distinct_titles(df: DataFrame, supplier: str, title: str, order: str, n: int) -> DataFrame:
    """At most ``n`` distinct titles per supplier, in input order."""
    first = df.where(F.coalesce(F.col(title), F.lit("")) != "").groupBy(supplier, title).agg(F.min(order).alias(order))
    return top_per_group(first, [supplier], [F.asc(order)], n)


def review_queue(matches: DataFrame, products: DataFrame, suppliers: DataFrame,
                 limit: int | None = None) -> DataFrame:
    """Undecided new products with their supplier, newest first; only ``limit`` of them where one is given."""
    open_ = matches.where((F.col("match_status") == "NEW_PRODUCT") & F.col("validation_decision").isNull())
    queue = open_.join(products, "product_id").join(suppliers, "supplier_id", "left").orderBy(F.desc("created_at"), F.desc("match_id"))
    return queue if limit is None else queue.limit(limit)


def export_queue(matches: DataFrame, products: DataFrame, raw: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Accepted products not exported yet, with raw source and supplier."""
    ready = matches.where((F.col("match_status") == "ACCEPTED") & F.col("external_id").isNull())
    return products.join(ready, "product_id").join(raw, "product_id", "left").join(suppliers, "supplier_id", "left")


def search(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows where any of the columns contains the text, ignoring case."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    return df.where(cond)


def facets(df: DataFrame, **allowed: Sequence) -> DataFrame:
    """Rows whose columns are among the chosen values; an empty choice filters nothing."""
    for column, values in allowed.items():
        if values:
            df = df.where(F.col(column).isin(*values))
    return df


def listing(df: DataFrame, *, activity: str | None = None, city: str | None = None, product_id=None, limit: int | None = None) -> DataFrame:
    """Product listing with defaults for missing values."""
    if activity is not None:
        df = df.where(F.col("activity") == activity)
    if city is not None:
        df = df.where(F.col("city") == city)
    if product_id is not None:
        df = df.where(F.col("product_id") == product_id)
    blank = F.lit("")
    out = df.select("product_id", F.coalesce("name", blank).alias("name"), F.coalesce("city", blank).alias("city"),
                    F.coalesce("country", blank).alias("country"), F.coalesce("activity", F.lit("EXCURSION")).alias("activity"),
                    F.coalesce("category", blank).alias("category"), F.coalesce(F.col("price").cast("int"), F.lit(0)).alias("price"),
                    F.coalesce("duration", F.lit(0)).alias("duration"))
    return out if limit is None else out.orderBy("product_id").limit(limit)


def country_matches(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Rows whose country contains one of the chosen names or is contained in one."""
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    cond = F.lit(False)
    for n in names:
        cond = cond | F.contains(low, F.lit(n.lower())) | F.contains(F.lit(n.lower()), low)
    return df.where(cond)


def disposition_counts(df: DataFrame, run: str, disposition: str = "disposition",
                       values: Sequence[str] = ("saved", "skipped", "rejected", "error")) -> DataFrame:
    """Counters of each run: extracted, and one per disposition."""
    return df.groupBy(run).agg(F.count("*").alias("extracted"), *[
        F.count_if(F.col(disposition) == v).alias(v) for v in values])
