"""Queries over the test tables and the SQL that checks them."""

from contract import queries_core, queries_formats, queries_jobs, queries_lake, queries_reports  # noqa: F401
from contract.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
