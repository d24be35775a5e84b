"""Registered queries with their SQL."""

from . import calibration, catalog, crossfit, expression, groups, models, nulls, panels, pooling, selection, tables, transfer
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "calibration", "catalog", "crossfit", "expression", "groups", "models", "nulls", "panels", "pooling", "selection", "tables", "transfer"]
