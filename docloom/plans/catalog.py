"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from docloom.plans import audits, composed, core, courses, documents, files, knowledge, predicates, search, texts
from docloom.plans.registry import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "audits", "composed", "core", "courses", "documents", "files", "knowledge", "predicates", "search", "texts"]
FLAGSHIP = "r02_bm25"
