"""Token counts of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bazaarflow.llm import tokencount
from bazaarflow.llm.common import table
from bazaarflow.llm.registry import query


@query("op13_batch_token_counts")
def op13_batch_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return tokencount.counted(docs, public_tokenizers.path("word_bpe_49k.json"))
