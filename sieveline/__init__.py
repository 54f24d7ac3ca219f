"""A Spark-native engine for text and code search."""

from .plans.query import InvalidPattern, Query, SearchOptions, UnsupportedRegex

__all__ = ["InvalidPattern", "Query", "SearchOptions", "UnsupportedRegex"]
