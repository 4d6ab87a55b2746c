"""Queries of the example study, one or more per operator."""

from .registry import ORACLES, QUERIES
from . import (aggregates, contracts, differencing, gateway_checks, model_fits, mixed_requests, session_rebuild, statistics,  # noqa: F401
               text_and_audit, views_and_filters)

__all__ = ["ORACLES", "QUERIES"]
