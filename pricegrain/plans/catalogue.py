"""All queries of the library; importing the modules registers them."""

from __future__ import annotations

from pricegrain.plans import changes, comparison, expressions, feeds, matching, pages, records, runs, search, service, streams, tables, upkeep
from pricegrain.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "changes", "comparison", "expressions", "feeds", "matching", "pages", "records", "runs", "search", "service", "streams", "tables", "upkeep"]
