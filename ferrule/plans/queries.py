"""All queries of the engine by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import audit, web  # noqa: F401  (they register their queries)
from .common import REGISTRY, Run
from .web import link_edges_by_host as flagship  # noqa: F401


def queries() -> dict[str, Run]:
    return {name: entry.run for name, entry in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry.sql for name, entry in REGISTRY.items() if entry.sql}
