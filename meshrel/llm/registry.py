"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chunks, decontamination, fingerprints, jaccard, languages, licenses, mixing, quality, suffixes, urls

MODULES = [mixing, urls, fingerprints, jaccard, suffixes, decontamination, chunks, quality, languages, licenses]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "SQL", {}).items()}
