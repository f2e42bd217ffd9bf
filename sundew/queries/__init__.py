"""Registered queries over the driver's tables, with SQL for each that SQL can express."""

from __future__ import annotations

from sundew.queries import aggregates, fields, joins, sequences, sources, streams  # noqa: F401
from sundew.queries.registry import QUERIES, SQL  # noqa: F401
