"""Token files of all documents, read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarflow.llm import records
from bazaarflow.llm.common import table
from bazaarflow.llm.registry import query


@query("op3_length_delimited_records")
def op3_length_delimited_records(spark: SparkSession, folder: str) -> DataFrame:
    manifest = records.write(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return records.read(manifest).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                                         F.crc32("ids").alias("ids_crc32"), "part", "record")
