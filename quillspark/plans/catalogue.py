"""All registered queries of the repository-knowledge engine, with their SQL."""

from __future__ import annotations

from . import evaluate, ingest, listing, outlines, state, texts

_MODULES = (listing, ingest, evaluate, outlines, texts, state)
QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.SQL.items()}
