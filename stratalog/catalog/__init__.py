"""Queries over the test tables, by name, and the same in SQL for DuckDB."""

from . import analyses, core
from .core import flagship  # noqa: F401

QUERIES = {**core.QUERIES, **analyses.QUERIES}
ORACLE_SQL = {**core.SQL, **analyses.SQL}
