"""Results as text, row by row, so that a driver holds one row at a time."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

from pyspark.sql import DataFrame

from lodestrand.functions import LANGUAGES


def _text(value) -> str:
    return "NULL" if value is None else str(int(value)) if isinstance(value, bool) else str(value)


def yaml_lines(query: str, rows: DataFrame) -> Iterator[str]:
    """The lines of a YAML report: the query, each row with its index, and the total."""
    yield f"query: {json.dumps(query, ensure_ascii=False)}"
    n = 0
    for n, row in enumerate(rows.toLocalIterator(), 1):
        if n == 1:
            yield "results:"
        yield f"  - index: {n - 1}"
        for column, value in zip(rows.columns, row, strict=True):
            value = _text(value)
            if "\n" in value:
                yield f"    {column}: |"
                yield from (f"      {line}" for line in value.split("\n"))
            else:
                yield f"    {column}: {json.dumps(value, ensure_ascii=False) if chr(34) in value or chr(39) in value else value}"
    if not n:
        yield "results: []"
        return
    yield ""
    yield f"total: {n}"


# The wording of reports, which readers of them rely on.
HEADER = "# Search Results\n\n**Query:** `{}`\n\n**Found {} results**\n\n"
PLACE = "**File:** `{}` | **Lines:** {}-{} | **Distance:** {:.4f}"
RELATED = "#### {}/{}: {} ({}) - Lines {}-{}\n\n"


def _block(path: str, content: str) -> str:
    tag = LANGUAGES.get(posixpath.splitext(path)[1], "")
    return f"```{tag}\n{content}" + ("" if content.endswith("\n") else "\n") + "```\n\n"


def markdown_report(query: str, hits: list, chunks: dict | None = None) -> str:
    """A report of search hits (path, content_snippet, start_line, end_line, distance).

    Hits with `related` (chunk_id, relation) go with the text of those that are among
    `chunks` (by id: path, content_snippet, start_line, end_line); others are counted only.
    """
    if not hits:
        return "No results found\n"
    out = [HEADER.format(query, len(hits))]
    for n, hit in enumerate(hits, 1):
        place = PLACE.format(hit["path"], hit["start_line"], hit["end_line"], hit["distance"])
        out.append(f"---\n\n## {n}/{len(hits)}. {posixpath.basename(hit['path'])}\n\n{place}\n\n{_block(hit['path'], hit['content_snippet'])}")
        related = (hit["related"] or []) if "related" in hit else []
        out += ["### Related Chunks\n\n"] * bool(related)
        for k, near in enumerate(related, 1):
            if (chunk := (chunks or {}).get(near["chunk_id"])) is not None:
                out.append(RELATED.format(k, len(related), chunk["path"], near["relation"], chunk["start_line"], chunk["end_line"]))
                out.append(_block(chunk["path"], chunk["content_snippet"]))
    return "".join(out)


def status_report(files: int, chunks: int, entities: int, edges: int, statuses: dict[str, int]) -> str:
    """Counts of everything; states without files aren't named."""
    lines = [f"Files: {files}", f"Chunks: {chunks}", f"Entities: {entities}", f"Edges: {edges}"]
    return "\n".join(lines + [f"  {s}: {statuses[s]}" for s in ("pending", "processing", "indexed", "failed") if statuses.get(s)]) + "\n"
