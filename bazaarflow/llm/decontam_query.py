"""Benchmark items that leaked into the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bazaarflow.llm import decontam
from bazaarflow.llm.common import table
from bazaarflow.llm.registry import query


@query("op5_latent_semantic_leaks")
def op5_latent_semantic_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
