"""The catalogue of runnable queries with their independent SQL."""

from tablekeep.plans import alerting, conforming, formats, geometries, governance, histories, names  # noqa: F401  (registers)
from tablekeep.plans.catalog import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
