"""Registered queries on the driver tables."""

from . import decision_queries, series_queries, service_queries, source_queries, support_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
