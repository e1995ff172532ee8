"""All registered queries with their SQL."""

from __future__ import annotations

from . import analyses, linkage, registry, texts

MODULES = (registry, texts, linkage, analyses)
QUERIES, ORACLE_SQL, FLAGSHIP = registry.QUERIES, registry.ORACLE_SQL, registry.FLAGSHIP
