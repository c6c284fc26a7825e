"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from samplewell.plans import q_config, q_scans, q_signals  # noqa: F401  (they register their queries)
from samplewell.plans.registry import ORACLES, QUERIES  # noqa: F401
