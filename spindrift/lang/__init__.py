"""The query language: text to syntax tree and back."""

from .parsing import QueryError, parse
from .syntax import Query

__all__ = ["Query", "QueryError", "parse"]
