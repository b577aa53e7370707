"""Prices, currencies and durations."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarflow import vocab
from bazaarflow.functions.rules import first_label, lit_map

MONEY, RATE = "decimal(14,2)", "decimal(18,8)"
NUMBER = r"(\d+(?:\.\d+)?)"


def first_match(c: Column, pattern: str, group: int = 1, flags: str = "(?i)") -> Column:
    """Group of the first match, null when the pattern does not occur."""
    return F.nullif(F.regexp_extract(c, flags + pattern, group), F.lit(""))


def to_number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def parse_price(raw: Column, symbols=vocab.CURRENCY_SYMBOLS, rates=vocab.RATES_TO_EUR, low: float = 1,
                high: float = 99999) -> Column:
    """struct(amount, currency) of a price string; amount null outside [low, high]."""
    text = F.coalesce(raw, F.lit(""))
    upper = F.upper(text)
    symbol = first_label(text, [([s], iso) for s, iso in symbols])
    code = first_label(upper, [([iso], iso) for iso, _ in rates if iso != "EUR"])
    digits = F.replace(F.regexp_replace(text, r"[^0-9.,]", " "), F.lit(","), F.lit("."))
    value = first_match(digits, NUMBER).try_cast("double")
    return F.struct(F.when(value.between(low, high), F.round(value, 2)).alias("amount"),
                    F.coalesce(symbol, code, F.lit("EUR")).alias("currency"))


def parse_shop_price(raw: Column, low: float = 1.0, high: float = 5000.0) -> Column:
    """struct(amount, currency) with the short currency list of page extraction; EUR on failure."""
    upper = F.upper(F.coalesce(raw, F.lit("")))
    digits = F.replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[^\d.,]", " "), F.lit(","), F.lit("."))
    value = first_match(digits, NUMBER).try_cast("double")
    ok = F.coalesce(value.between(low, high), F.lit(False))
    currency = first_label(upper, [(["€", "EUR"], "EUR"), (["$", "USD"], "USD"), (["£", "GBP"], "GBP")], "EUR")
    return F.struct(F.when(ok, F.round(value, 2)).alias("amount"),
                    F.when(ok, currency).otherwise(F.lit("EUR")).alias("currency"))


def plain_number(c: Column) -> Column:
    """Digits and points of a formatted amount, as double."""
    return F.nullif(F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), r"[^\d.]", ""), F.lit("")).try_cast("double")


def text_price(text: Column, patterns=vocab.TEXT_PRICE_PATTERNS) -> Column:
    """struct(amount, currency) of the first pattern with a positive amount, null if none."""
    out = []
    for pattern, currency in patterns:
        value = to_number(first_match(text, pattern))
        out.append(F.when(value > 0, F.struct(value.alias("amount"), F.lit(currency).alias("currency"))))
    return F.coalesce(*out)


def loose_price(text: Column, patterns=vocab.LOOSE_PRICE_PATTERNS) -> Column:
    return F.coalesce(*[plain_number(first_match(text, p)) for p in patterns])


def service_price(text: Column, existing: Column, patterns=vocab.SERVICE_PRICE_PATTERNS, high: float = 100_000) -> Column:
    """The existing price when sane, else the first sane amount in the text."""
    found = [F.when((v > 0) & (v <= high), v) for v in (to_number(first_match(text, p)) for p in patterns)]
    return F.coalesce(F.when((existing > 0) & (existing <= high), existing), *found)


def convert(amount: Column, rate: Column) -> Column:
    """Fixed-point conversion; a missing rate passes the amount through."""
    fixed = amount.cast(MONEY) * F.coalesce(rate.cast(RATE), F.lit(1).cast(RATE))
    return F.round(fixed, 2).cast("double")


def rate_of(currency: Column, rates=vocab.STAGE_RATES) -> Column:
    return F.try_element_at(lit_map(rates), F.upper(F.trim(currency)))


def to_eur(df: DataFrame, rates: DataFrame, amount: str, currency: str, out: str = "eur") -> DataFrame:
    """Adds the amount in EUR. ``rates`` is a table (currency, rate), one row per currency."""
    key = rates.select(F.upper("currency").alias("_code"), F.col("rate").alias("_rate"))
    joined = df.join(key, F.upper(F.col(currency)) == F.col("_code"), "left")
    return joined.withColumn(out, convert(F.col(amount), F.col("_rate"))).drop("_code", "_rate")


def rates_table(spark, rates=vocab.RATES_TO_EUR) -> DataFrame:
    return spark.createDataFrame(list(rates), "currency string, rate double")


def process_price(df: DataFrame, price: str, currency: str, text: Column, *, rates=vocab.STAGE_RATES, out: str = "eur",
                  flag_out: str = "estimated", low=vocab.PRICE_MIN_EUR, flag=vocab.PRICE_FLAG_EUR,
                  absurd=vocab.PRICE_ABSURD_EUR) -> DataFrame:
    """Adds the price in EUR and whether it is an estimate: the stated price, else the first price in the text.

    A stated price outside [low, absurd) is dropped, not replaced by one from the text. Each step is a column
    of its own, so no pattern runs twice on a row.
    """
    code = F.upper(F.trim(F.coalesce(F.col(currency), F.lit("EUR"))))
    stated, found = F.col("_stated"), F.col("_found")
    has_stated = F.coalesce(F.col(price) > 0, F.lit(False))
    ok = F.coalesce((stated >= low) & (stated < absurd), F.lit(False))
    found_ok = F.coalesce((found >= low) & (found < absurd), F.lit(False))
    eur = F.when(has_stated, F.when(ok, stated)).when(found_ok, found)
    estimated = F.when(has_stated & ok, stated > flag).when(~has_stated & found_ok, F.lit(False)).otherwise(F.lit(True))
    return (df.withColumn("_stated", convert(F.col(price), rate_of(code, rates)))
            .withColumn("_mention", F.when(~has_stated, text_price(text)))
            .withColumn("_found", convert(F.col("_mention.amount"), rate_of(F.col("_mention.currency"), rates)))
            .withColumns({"_eur": eur, "_est": estimated}).drop("_stated", "_mention", "_found")
            .withColumns({out: F.col("_eur"), flag_out: F.col("_est")}).drop("_eur", "_est"))


def price_bound(activity: Column, side: int, bounds=vocab.PRICE_BOUNDS, default=vocab.PRICE_BOUNDS_DEFAULT) -> Column:
    return F.coalesce(F.try_element_at(lit_map([(k, v[side]) for k, v in bounds.items()]), activity),
                      F.lit(default[side]))


def clamp_price(price: Column, activity: Column, bounds=vocab.PRICE_BOUNDS, default=vocab.PRICE_BOUNDS_DEFAULT) -> Column:
    low, high = price_bound(activity, 0, bounds, default), price_bound(activity, 1, bounds, default)
    return F.when(price.isNotNull(), F.greatest(F.least(price, high), low))


def rule_price(text: Column, activity: Column, rules=vocab.PRICE_RULES, by_activity=vocab.PRICE_BY_ACTIVITY,
               default=vocab.PRICE_RULE_DEFAULT) -> Column:
    """Typical price of the first keyword found, else of the activity."""
    fallback = F.coalesce(F.try_element_at(lit_map(by_activity), F.lower(activity)), F.lit(default))
    return first_label(text, [([k], v) for k, v in rules], fallback)


def default_price(activity: Column, prices=vocab.DEFAULT_PRICES, default=vocab.DEFAULT_PRICE) -> Column:
    return F.coalesce(F.try_element_at(lit_map(prices.items()), activity), F.lit(default))


def minutes_first(raw: Column, day_minutes: int = 480) -> Column:
    """Minutes of the first unit that occurs: hours, minutes, days."""
    low = F.lower(raw)
    hours = F.floor(first_match(low, r"(\d+(?:\.\d+)?)\s*h").try_cast("double") * 60).cast("int")
    minutes = first_match(low, r"(\d+)\s*min").try_cast("int")
    days = first_match(low, r"(\d+)\s*(?:day|jour)").try_cast("int") * day_minutes
    return F.coalesce(hours, minutes, days)


def minutes_sum(raw: Column, patterns=vocab.DURATION_PATTERNS) -> Column:
    """Sum over the units that occur (a day is 1440 minutes here); null when none does."""
    low = F.lower(raw)
    parts = [F.coalesce(first_match(low, p).try_cast("int") * k, F.lit(0)) for p, k in patterns]
    return F.nullif(functools.reduce(operator.add, parts), F.lit(0))


def minutes_of(hours: Column, minutes: Column) -> Column:
    return F.nullif(F.coalesce(hours, F.lit(0)) * 60 + F.coalesce(minutes, F.lit(0)), F.lit(0))


def derived_prices(price: Column, purchase: float = 0.85, low: float = 0.8, high: float = 1.2) -> Column:
    """struct(purchase, minimum, maximum), in fixed-point arithmetic."""
    def share(factor: float) -> Column:
        return F.round(price.cast(MONEY) * F.lit(factor).cast("decimal(4,2)"), 2).cast("double")

    return F.struct(share(purchase).alias("purchase"), share(low).alias("minimum"), share(high).alias("maximum"))


def code_label(code: Column, pairs, default: str) -> Column:
    """Label of a code from a short list, with a default."""
    return F.coalesce(F.try_element_at(lit_map(pairs), F.trim(code.cast("string"))), F.lit(default))


def is_eurozone(country: Column, members=vocab.EUROZONE) -> Column:
    return F.coalesce(F.lower(F.trim(country)).isin(*members), F.lit(False))


def price_near(html_slice: Column) -> Column:
    """First text run with a currency sign or code."""
    return first_match(html_slice, r">([^<>]*(?:[\$€£¥]|USD|EUR|AED|DZD|TND)[^<>]*)<", 1, "")

