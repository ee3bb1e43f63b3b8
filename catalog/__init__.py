"""Queries over the driver tables that exercise every operator, with their oracle SQL."""

from . import queries_feeds, queries_listing, queries_state, queries_text  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
