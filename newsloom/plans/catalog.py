"""All named queries; importing a module registers its queries."""

from __future__ import annotations

import importlib

from newsloom.plans import registry, views_sql  # noqa: F401

MODULES = (
    "ingest", "articles", "interactions", "embed", "vectors", "classify", "processing", "recommend", "retrieve", "chat",
    "metrics", "streams",
)

for _name in MODULES:
    importlib.import_module(f"newsloom.plans.{_name}")


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: registry.oracle_text(sql) for name, sql in registry.ORACLE.items()}
