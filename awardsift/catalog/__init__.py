"""Registered queries over the test tables, each with the SQL that checks it where SQL can."""

from . import aggregates, features, filters, joins, model, ordering, projections, readback, storage  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
