"""All queries of the core library."""

from __future__ import annotations

from loam.plans import evaluation, graphs, problems, registry, relational, series, spatial, storage  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
