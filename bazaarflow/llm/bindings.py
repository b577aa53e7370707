"""All queries of the subpackage."""

import importlib

from bazaarflow.llm.registry import ORACLES, QUERIES

for _name in ("quality_query", "packing_query", "records_query", "warc_query", "sharding_query", "langid_query", "lmscore_query", "neardup_query",
              "linedup_query", "decontam_query", "negatives_query", "turns_query", "tokencount_query"):
    importlib.import_module(f"bazaarflow.llm.{_name}")

__all__ = ["ORACLES", "QUERIES"]
