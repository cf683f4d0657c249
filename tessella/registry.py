"""All registered queries of the library and their SQL."""

from __future__ import annotations

from tessella.queries import actions, graphs, literals, records, searching, timelines

MODULES = [searching, graphs, timelines, records, literals, actions]
QUERIES: dict = {name: run for m in MODULES for name, run in m.QUERIES.items()}
SQL: dict[str, str] = {name: sql for m in MODULES for name, sql in m.SQL.items()}
