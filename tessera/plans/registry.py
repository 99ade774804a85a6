"""All registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from tessera.queries import endtoend, measures, pieces, retrieval, sql, state, streams, texts
from tessera.queries.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "endtoend", "measures", "pieces", "retrieval", "sql", "state", "streams", "texts"]
