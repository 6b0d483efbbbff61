"""Queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .plans import checks, documents, evolution, operations, profiles, stored, vacancies

MODULES = [evolution, profiles, vacancies, operations, stored, documents, checks]
QUERIES: dict = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in MODULES for k, s in m.SQL.items()}
