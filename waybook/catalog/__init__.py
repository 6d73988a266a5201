"""Queries over the given tables and their SQL counterparts."""

from waybook.catalog import (  # noqa: F401
    aggregates,
    conversations,
    filters,
    jobs,
    joins,
    sets,
    sources,
    streams,
    text,
    windows,
)
from waybook.catalog.registry import ORACLES, QUERIES  # noqa: F401
