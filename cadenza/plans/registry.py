"""All queries of the domain by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from cadenza.plans import edits, engagement, lifecycle, texts, transcripts

FLAGSHIP = "insights_by_platform"
MODULES = [engagement, lifecycle, transcripts, texts, edits]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
