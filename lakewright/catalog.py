"""All registered queries of the core library and their SQL twins."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}
for _name in ("corpus", "retrieval", "evidence", "analytics"):
    _module = importlib.import_module(f"lakewright.queries.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
