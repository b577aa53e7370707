"""Sixteen shards of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarflow.llm import sharding
from bazaarflow.llm.common import table
from bazaarflow.llm.registry import query

SHARDS = 16


@query("op1_vector_bin_packing")
def op1_vector_bin_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("id"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null")).alias("key"),
        (F.octet_length(text) + 1).cast("long").alias("bytes"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("tokens"),
        F.lit(1).cast("long").alias("rows"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.slots(sharding.assign(rows, SHARDS), ["id", "key"], docs.count(), SHARDS)
    return placed.select(F.col("id").alias("doc_id"), F.col("bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"),
                         "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("tokens").alias("n_tokens"))
