"""All pages as WARC records, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarflow.llm import warc
from bazaarflow.llm.common import table
from bazaarflow.llm.registry import query


@query("op4_chunked_warc")
def op4_chunked_warc(spark: SparkSession, folder: str) -> DataFrame:
    manifest = warc.write(table(spark, folder, "pages"))
    return warc.read(manifest, payload=False).where("last").select(
        F.col("record_id").alias("page_id"), F.col("n_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), "record_type", "refers_to")
