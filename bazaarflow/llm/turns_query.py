"""All conversations, damaged by rule and repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarflow.llm import turns
from bazaarflow.llm.common import materialise, table
from bazaarflow.llm.registry import query


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text): one in twenty is dropped, and as many lose their text or its marks, are repeated, or
    get the role user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text = F.coalesce("text", space)
    named = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"),
                        (F.crc32(key.cast("binary")) % 20).alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return named.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                        F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


@query("op12_target_alignment")
def op12_target_alignment(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    given = damaged(rows)
    found = materialise(turns.report(given), "report")
    hashes = turns.digests(turns.repaired(given, found.select("conv_id", "audit"))).withColumnRenamed("conv_id", "_h")
    names = rows.select(F.col("conv_id").alias("_all")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return names.join(found, F.col("_all").eqNullSafe(F.col("conv_id")), "left") \
        .join(hashes, F.col("_all").eqNullSafe(F.col("_h")), "left") \
        .select(F.col("_all").alias("conv_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
                F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
