"""Packing of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarflow.llm import packing
from bazaarflow.llm.common import table
from bazaarflow.llm.registry import query


def packed_documents(docs: DataFrame) -> DataFrame:
    """Pieces of at most 1024 tokens with the checksum of their ids; the ids stay out of the shuffle."""
    pieces = packing.cut(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), docs.count())


@query("op7_vector_best_fit")
def op7_vector_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return packed_documents(table(spark, folder, "documents"))
