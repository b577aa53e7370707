"""Language-model scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarflow.llm import lmscore
from bazaarflow.llm.common import crc32_of_id, table
from bazaarflow.llm.registry import query


@query("op9_log_frequency_bloom")
def op9_log_frequency_bloom(spark: SparkSession, folder: str) -> DataFrame:
    held_out = crc32_of_id(F.col("doc_id")) % 7 == 2
    docs = table(spark, folder, "documents").select("doc_id", held_out.alias("held_out"), "text")
    return lmscore.score(docs, ~F.col("held_out"))
