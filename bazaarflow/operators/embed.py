"""Embedding of a text column: every distinct text is embedded once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarflow.session import materialise


def hashed_vectors(df: DataFrame, text: str, out: str = "embedding", size: int = 64) -> DataFrame:
    """Unit vectors of hashed word counts; no model needed."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    counted = HashingTF(numFeatures=size, inputCol="_words", outputCol="_tf").transform(df.withColumn("_words", words))
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(counted)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")


def _buckets(text: Column, size: int) -> Column:
    """The bucket of every word, by the first eight digits of its MD5."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % size).cast("int"))


def _distinct_texts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.md5(text).alias("_h"), F.col(text).alias("_t")).where(F.coalesce(F.length("_t"), F.lit(0)) > 0) \
        .groupBy("_h").agg(F.first("_t").alias("_t"))


def fit_idf(df: DataFrame, text: str, size: int = 64) -> DataFrame:
    """Inverse document frequencies over the distinct texts, ln((N + 1) / (n + 1)): ``size`` rows (bucket, idf).

    An ordinary table: written once, it embeds later texts alike.
    """
    return _fitted(_distinct_texts(df, text).select(_buckets(F.col("_t"), size).alias("_b")), size)


def _fitted(texts: DataFrame, size: int) -> DataFrame:
    """``fit_idf`` from the buckets ``_b`` of the distinct texts."""
    seen = texts.select(F.explode(F.array_distinct("_b")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("_n"))
    total = texts.agg(F.count("*").alias("_all"))
    return (texts.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket")).join(seen, "bucket", "left").join(F.broadcast(total))
            .select("bucket", F.log((F.col("_all") + 1) / (F.coalesce("_n", F.lit(0)) + 1)).alias("idf")))


def idf_vectors(texts: DataFrame, key: str, text: str, idf: DataFrame, out: str = "embedding", size: int = 64) -> DataFrame:
    """Unit vectors of hashed word counts weighted by ``idf`` (of ``fit_idf`` with the same size): key, out.

    ``key`` is unique; a text without words, or with words of weight 0 only, gets zeros.
    """
    return _weighted(texts.select(key, _buckets(F.col(text), size).alias("_b")), key, idf, out, size)


def _weighted(texts: DataFrame, key: str, idf: DataFrame, out: str, size: int) -> DataFrame:
    """``idf_vectors`` from the buckets ``_b`` of the texts."""
    counts = texts.select(key, F.explode("_b").alias("bucket")).groupBy(key, "bucket").agg(F.count("*").alias("_n"))
    weighted = counts.join(F.broadcast(idf), "bucket").select(key, "bucket", (F.col("_n") * F.col("idf")).alias("_x"))  # size rows
    rows = weighted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "_x"))).alias("_m"),
                                     F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_norm"))
    value = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda b: F.when(F.col("_norm") > 0, F.coalesce(
        F.try_element_at("_m", b), F.lit(0.0)) / F.col("_norm")).otherwise(F.lit(0.0)).cast("float"))
    return texts.select(key).join(rows, key, "left").select(key, value.alias(out))


def embed_distinct(df: DataFrame, text: str, embedder: Callable[[pd.Series], list] | None = None,
                   out: str = "embedding", idf: DataFrame | None = None, size: int = 64) -> DataFrame:
    """Adds the embedding of ``text``; equal texts are embedded once, null or empty texts get none.

    ``embedder`` takes a Series of texts and returns one vector each (it runs inside the tasks, batch by
    batch); without one, hashed word counts weighted by ``idf`` are used, fitted on these texts where none is given.
    """
    texts = _distinct_texts(df, text)
    if embedder is None:
        # the words of a text are hashed once: written, as the weights and the vectors both read them
        texts = materialise(texts.select("_h", _buckets(F.col("_t"), size).alias("_b")), "buckets")
        vectors = _weighted(texts, "_h", _fitted(texts, size) if idf is None else idf, out, size)
    else:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"_h": batch["_h"], out: list(embedder(batch["_t"]))})

        vectors = texts.mapInPandas(run, f"_h string, {out} array<float>")
    return df.withColumn("_key", F.md5(text)).join(vectors, F.col("_key") == F.col("_h"), "left").drop("_key", "_h")
