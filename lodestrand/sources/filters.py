"""Path predicates: which directories and files are indexed."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Java's regular expressions have and linear-time ones don't.
_NOT_LINEAR = re.compile(r"\(\?[=!]|\(\?<[=!]|\\[1-9]|[*+?}]\+|\(\?>")


def usable_patterns(patterns: list[str]) -> list[str]:
    """The patterns that are regular expressions; others are left out, never an error."""
    out = []
    for pattern in patterns:
        try:
            re.compile(pattern)
        except re.error:
            continue
        if not _NOT_LINEAR.search(pattern):
            out.append(pattern.replace("(?P<", "(?<"))
    return out


def _any(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in usable_patterns(patterns):
        out = out | path.rlike(p)
    return out


def index_file(path: Column, blacklist: list[str], whitelist: list[str]) -> Column:
    """Not blacklisted, or whitelisted; patterns match anywhere in the path."""
    return ~_any(path, blacklist) | _any(path, whitelist)


def _glob(pattern: str) -> str | None:
    """A glob over one name as a regular expression, or None if it is malformed."""
    depth = 0
    for c in re.sub(r"\\.", "", pattern):
        depth += (c == "[") - (c == "]" and depth > 0)
    return None if depth else fnmatch.translate(pattern).replace(r"(?s:", "(?s:").replace(r"\Z", "$").replace(r"\z", "$")


def index_directory(path: Column, include: list[str], exclude: list[str]) -> Column:
    """In an included folder (or one itself) and not excluded: by a glob over its own
    name, by prefix, or as a folder within the path.  A bad glob is a plain substring."""
    inside = F.lit(False)
    for folder in include:
        inside = inside | (path == folder) | path.startswith(folder.rstrip("/") + "/")
    base, out = F.regexp_extract(path, r"([^/]*)/*$", 1), F.lit(False)
    for pattern in exclude:
        glob = _glob(pattern)
        out = out | (path.contains(pattern) if glob is None else base.rlike(f"^{glob}$"))
        out = out | path.startswith(pattern) | path.contains(f"/{pattern}/") | path.endswith(f"/{pattern}")
    return inside & ~out


def matches_pattern(path: Column, pattern: str) -> Column:
    """A glob over the name, or a regular expression, or a substring."""
    base, glob, out = F.regexp_extract(path, r"([^/]*)$", 1), _glob(pattern), path.contains(pattern)
    if glob is not None:
        out = out | base.rlike(f"^{glob}$")
    return out | path.rlike(usable_patterns([pattern])[0]) if usable_patterns([pattern]) else out


def daemon_filter(path: Column, include: list[str], exclude: list[str], blacklist: list[str], whitelist: list[str]) -> Column:
    """index_directory() for the folder and index_file() for the file."""
    return index_directory(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), include, exclude) & index_file(path, blacklist, whitelist)
