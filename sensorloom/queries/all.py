"""Importing this module registers every query of the library."""

from sensorloom.queries import cleaning, forecasting, graphs, grids, io, models  # noqa: F401
from sensorloom.queries.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
