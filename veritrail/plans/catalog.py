"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from veritrail.plans import anchor_queries, boundary_queries, budget_queries, conversion_queries, envelope_queries, inventory_queries, record_queries, recovery_queries, rule_queries, text_queries

_PARTS = (text_queries, record_queries, rule_queries, boundary_queries, envelope_queries, anchor_queries, inventory_queries, budget_queries, conversion_queries, recovery_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
