"""Errors of graph queries."""

from __future__ import annotations


class QueryError(ValueError):
    """A graph query that can't be run."""


class QuerySyntaxError(QueryError):
    """Text that the grammar doesn't have; knows where, what could stand there and what does."""

    def __init__(self, line: int, column: int, expected: str, got: str):
        self.line, self.column, self.expected, self.got = line, column, expected, got
        super().__init__(f"parse error: {line}:{column}: error: expected {expected}; got: {got}")


class QuerySemanticError(QueryError):
    """A query that parses and means nothing."""
