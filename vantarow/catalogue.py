"""The library's own queries and the SQL that states the same results."""

from __future__ import annotations

from vantarow.plans import detection, knowledge, machines, neural, platform, streams, supervised

_PARTS = (detection.REGISTRY, knowledge.REGISTRY, platform.REGISTRY, supervised.REGISTRY, neural.REGISTRY, streams.REGISTRY, machines.REGISTRY)
QUERIES = {name: f for part in _PARTS for name, f in part.queries.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.sql.items()}
