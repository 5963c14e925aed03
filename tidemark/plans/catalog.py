"""All registered queries and their SQL."""

from __future__ import annotations

from . import census_queries, event_queries, nowcast_queries, record_queries, trade_queries, vector_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "complete_group_asof"
