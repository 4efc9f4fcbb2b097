"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from huetide.plans import catalog, dated, evidence, history, landed, proofs, shapes, sources, streams  # noqa: F401  each module registers its queries


def queries() -> dict[str, catalog.Query]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLES)
