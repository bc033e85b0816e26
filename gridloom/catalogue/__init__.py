"""Queries over the test tables, one or more for each operator, with their SQL."""

from __future__ import annotations

from . import cells, ingest, learn, spread

QUERIES = cells.QUERIES | spread.QUERIES | learn.QUERIES | ingest.QUERIES
ORACLE_SQL = cells.ORACLE_SQL | spread.ORACLE_SQL | learn.ORACLE_SQL | ingest.ORACLE_SQL
