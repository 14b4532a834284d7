"""Queries over the driver's tables and the SQL each one is checked against."""

from __future__ import annotations

from registry import catalogue, images, metrics, reports, splits, training

_MODULES = (catalogue, splits, metrics, reports, images, training)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
