"""All registered queries and their SQL."""

from __future__ import annotations

from . import flows, oracles, queries

QUERIES = queries.QUERIES | {f.__name__: f for f in flows.FLOWS}
ORACLES = oracles.ORACLES | flows.SQL
