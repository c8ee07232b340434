"""All registered queries."""

from __future__ import annotations

from postmill.plans import (  # noqa: F401  (they register themselves)
    board_plans, model_plans, report_plans, state_plans, stream_plans, text_plans,
)
from postmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]

flagship = report_plans.flagship
