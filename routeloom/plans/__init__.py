"""Registered queries, the SQL they are checked against, and the tables they run on."""

from . import (  # noqa: F401
    document_queries,
    heuristic_queries,
    report_queries,
    round_trip_queries,
    routing_queries,
    stream_queries,
    text_queries,
)
from .registry import ORACLES, QUERIES  # noqa: F401
