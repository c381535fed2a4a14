"""chartloom: evaluates the data part of declarative chart specifications on Spark."""

from chartloom.runtime import Runtime, get_column_usage, get_inline_column_usage

__all__ = ["Runtime", "get_column_usage", "get_inline_column_usage"]
