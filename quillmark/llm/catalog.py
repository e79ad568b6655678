"""The queries of this package and their SQL, for the registry."""

from __future__ import annotations

from quillmark.llm import cooccurrence, leaks, lookalikes, neardups, packing, splitting, vectorgraph

_MODULES = (vectorgraph, splitting, cooccurrence, neardups, packing, leaks, lookalikes)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
