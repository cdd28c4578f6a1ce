"""All queries, gathered by importing the modules that register them."""

from . import (  # noqa: F401
    curve_queries,
    identity_queries,
    link_queries,
    path_queries,
    session_queries,
    source_queries,
    stat_queries,
    touch_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
