"""Classes of near duplicates among all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bazaarflow.llm import neardup
from bazaarflow.llm.common import numbered, table
from bazaarflow.llm.registry import query


@query("op8_order_minhash")
def op8_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    rows = numbered(table(spark, folder, "documents").select("doc_id", "text"), "_rid")
    return neardup.classes(rows).drop("_rid")
