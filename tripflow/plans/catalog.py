"""All registered queries."""

from __future__ import annotations

from tripflow.plans import (  # noqa: F401
    analysis_queries,
    forecast_queries,
    panel_queries,
    place_queries,
    quality_queries,
    rollup_queries,
    source_queries,
)
from tripflow.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
