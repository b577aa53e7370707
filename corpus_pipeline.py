"""From raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarflow.llm import decontam, linedup, neardup, quality
from bazaarflow.llm.common import materialise, table
from bazaarflow.llm.packing_query import packed_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what neither the base rules nor the learned list rejects."""
    featured = materialise(quality.features(docs, prefix="q_out_"), "featured")
    rules = quality.learn(featured, table(spark, sf_dir, "labels"), prefix="q_out_")
    kept = ~quality.base_failed("q_out_") & (rules.rule("q_out_") == 0)
    return featured.where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one line of each group of like lines; a document all of whose lines are kept elsewhere goes."""
    found = linedup.deduplicated(docs)
    gone = (F.col("n_lines") > 0) & (F.col("n_lines") == F.col("n_removed"))
    columns = [F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c)
               if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return found.where(~gone).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents into which no benchmark item has leaked."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences of at most 1024 tokens."""
    return packed_documents(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("MinHash near-dedup", near_duplicates),
          ("benchmark decontamination", decontamination), ("best-fit packing", packing)]

#: The learned rules, signatures and tokens have no SQL. Tests hold the operators of the stages against brute-force versions, not run() as a whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
