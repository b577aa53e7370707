"""The language of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bazaarflow.llm import langid
from bazaarflow.llm.common import table
from bazaarflow.llm.registry import query


@query("op2_kneser_ney_language")
def op2_kneser_ney_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))
