"""Operators of a training-data pipeline over ``documents``. Nothing else in the library imports this package."""

from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
