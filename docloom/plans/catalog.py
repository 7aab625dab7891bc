"""All registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from docloom.plans import indexes, joins, memories, more, relational, rollups, search, state, texts, upkeep

MODULES = (rollups, joins, search, indexes, memories, texts, relational, state, more, upkeep)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
