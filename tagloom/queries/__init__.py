"""Registered queries, one per operator, with the SQL that states the same result."""

from __future__ import annotations

from . import checks, labelling, metrics, parsing, planning, runs, saving, streams, text

_MODULES = (planning, text, parsing, checks, labelling, saving, metrics, runs, streams)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
