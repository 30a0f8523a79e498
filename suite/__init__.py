"""Registered queries: one per inventory row, each beside the SQL that checks it."""

from suite import counts, jobs, joins, scalars, series, storage, streams  # noqa: F401  (they register)
from suite.base import QUERIES

__all__ = ["QUERIES"]
