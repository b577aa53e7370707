"""All registered queries."""

import importlib

from bazaarflow.plans.registry import ORACLES, QUERIES

for _name in ("text_queries", "money_queries", "web_queries", "match_queries", "report_queries", "catalogue_queries"):
    importlib.import_module(f"bazaarflow.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
