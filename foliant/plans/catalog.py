"""All queries of the library itself."""

from __future__ import annotations

from foliant.plans import cases, evidence, parsing, projects, records, similarity, texts  # noqa: F401
from foliant.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
