"""All registered queries."""

from __future__ import annotations

from docaudit.plans import (  # noqa: F401
    queries_inventory,
    queries_jobs,
    queries_links,
    queries_people,
    queries_rules,
    queries_tables,
    queries_verify,
)
from docaudit.plans.registry import QUERIES

__all__ = ["QUERIES"]
