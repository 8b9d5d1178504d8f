"""Registered queries and their SQL checks."""

from .plans import areas, geometry, oracles, queries

QUERIES = queries.QUERIES | areas.QUERIES | geometry.QUERIES
ORACLES = oracles.ORACLES | areas.ORACLES | geometry.ORACLES
