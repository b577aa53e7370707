"""Quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarflow.llm import quality
from bazaarflow.llm.common import materialise, table
from bazaarflow.llm.registry import query


@query("op10_decision_list")
def op10_decision_list(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on each document; ``rule`` is the number of the learned rule that rejects it, 0 if none does."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    featured = materialise(quality.features(docs).drop("text"), "features")
    rules = quality.learn(featured, table(spark, folder, "labels"))
    rule = rules.rule()
    return featured.select("doc_id", *quality.COUNTS, quality.base_failed().alias("base_failed"),
                           (~quality.base_failed() & (rule == 0)).alias("kept"), rule.alias("rule"))
