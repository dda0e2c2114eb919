"""Scalar functions over paths and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and their languages.
LANGUAGES = {
    ".go": "go", ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".rs": "rust", ".rb": "ruby", ".php": "php",
    ".sh": "bash", ".bash": "bash", ".sql": "sql", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".xml": "xml", ".md": "markdown",
}


def language(path: Column) -> Column:
    """The language of a path's extension, or the empty string."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.regexp_extract(path, r"(\.[^./]*)$", 1)), F.lit(""))


def indent(text: Column, by: str) -> Column:
    """Every line of a text after a prefix."""
    return F.concat(F.lit(by), F.replace(text, F.lit("\n"), F.lit("\n" + by)))
