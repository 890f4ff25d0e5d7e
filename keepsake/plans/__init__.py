"""Queries over the test tables, one module per area."""

from keepsake.plans.registry import REGISTRY, Plan, Tables, plan

from keepsake.plans import (  # noqa: E402,F401  isort:skip
    aggregated, changes, filing, ingest, joined, lookups, search, streams, texts, timeseries,
)

__all__ = ["REGISTRY", "Plan", "Tables", "plan"]
