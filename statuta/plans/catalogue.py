"""All queries of the core with their SQL, by name."""

from __future__ import annotations

from statuta.plans import corpus, general, retrieval

_MODULES = (general, retrieval, corpus)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in _MODULES for name, q in m.SQL.items()}
