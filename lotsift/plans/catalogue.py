"""All queries of the domain by name, and their SQL."""

from __future__ import annotations

from . import ledgers, spatial_lookup, texts, vectors

_PARTS = (spatial_lookup, texts, vectors, ledgers)
QUERIES = dict(sorted((name, query) for part in _PARTS for name, query in part.QUERIES.items()))
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
