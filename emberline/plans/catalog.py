"""All registered queries of the engine and their DuckDB counterparts."""

from emberline.plans import assembly, content, correlation, decisions, incidents, service, topology

_MODULES = (correlation, topology, decisions, content, service, incidents, assembly)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
