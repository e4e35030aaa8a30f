"""All queries by name, and their SQL."""

from __future__ import annotations

from . import books, feeds, graphs, names, panels, reads, stored
from .base import Query

PARTS = (reads, panels, books, graphs, names, feeds, stored)


def queries() -> dict[str, Query]:
    return {n: q for p in PARTS for n, q in p.CATALOG.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for p in PARTS for n, s in p.CATALOG.sql.items()}
