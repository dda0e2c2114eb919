"""Relations from chunks by a language model: prompts, answers, edges."""

from __future__ import annotations

import hashlib
import json
import re
import struct
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand import schemas
from lodestrand.operators.registry import upsert_edges, upsert_entities
from lodestrand.shipping import ship

BATCH, ERRORS_SHOWN = 100, 5
FIELDS = ("source", "source_type", "target", "target_type", "relation_type")
FENCE = "```"


class Embedder(Protocol):
    """Turns texts into vectors, in order; must be picklable."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Extractor(Protocol):
    """Answers a prompt; must be picklable."""

    def complete(self, prompt: str) -> str: ...


class HashEmbedder:
    """Vectors from digests of words: no network, the same everywhere."""

    def __init__(self, dim: int = 768):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for word in text.lower().split():
                place, sign = struct.unpack("<Ib", hashlib.blake2b(word.encode(), digest_size=5).digest())
                v[place % self.dim] += 1.0 if sign >= 0 else -1.0
            size = sum(x * x for x in v) ** 0.5
            out.append([x / size for x in v] if size else v)
        return out


def embed(rows: DataFrame, text: str, embedder: Embedder, batch: int = 20) -> DataFrame:
    """rows with embedding (array<float>)."""
    ship(rows.sparkSession)

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        values = texts.fillna("").tolist()
        return pd.Series([v for i in range(0, len(values), batch) for v in embedder.embed(values[i : i + batch])])

    return rows.withColumn("embedding", vectors(F.col(text)))


def build_prompt(chunks: list[tuple[int, int, str | None, str]]) -> tuple[str, dict[int, tuple[int, int]]]:
    """A prompt over (chunk_id, file_id, path, text), numbered from 1, and what each number means."""
    parts = ["Name the entities in each chunk and how they relate. Answer with one JSON object a line, with the keys chunk, source, source_type, target, target_type and relation_type. Types are upper-case, relations lower-case."]
    meaning = {}
    for n, (chunk_id, file_id, path, text) in enumerate(chunks, 1):
        meaning[n] = (chunk_id, file_id)
        parts.append(f"## Chunk {n}\n" + (f"File: {path}\n" if path else "") + f"{FENCE}\n{text}\n{FENCE}")
    return "\n\n".join(parts) + "\n", meaning


def strip_fence(text: str) -> str:
    """The inside of an answer that is one fenced block, or the answer."""
    text = text.strip()
    if not text.startswith(FENCE):
        return text
    lines = text.split("\n")[1:]
    for i in range(len(lines) - 1, -1, -1):
        if lines[i].strip() == FENCE:
            return "\n".join(lines[:i]).strip()
    return "\n".join(lines).strip()


class AnswerError(ValueError):
    """An answer of which no line can be used."""


def _edge(line: str, meaning: dict[int, tuple[int, int]]) -> tuple:
    found = json.loads(line)
    if not isinstance(found, dict):
        raise ValueError("not an object")
    found = {k.lower(): v for k, v in found.items()}
    number = found.get("chunk") or 0
    if type(number) is not int:
        raise ValueError("chunk isn't an integer")
    values = [found.get(f) if found.get(f) is not None else "" for f in FIELDS]
    if any(type(v) is not str for v in values):
        raise ValueError("a field isn't a string")
    if number not in meaning:
        raise ValueError(f"invalid chunk number {number}")
    return (*values, *meaning[number])


def parse_jsonl(text: str, meaning: dict[int, tuple[int, int]]) -> list[tuple]:
    """Edges (FIELDS, chunk_id, file_id) of an answer's lines; bad lines are skipped, and
    an error only if there is nothing else."""
    edges, errors = [], []
    for n, line in enumerate(strip_fence(text).split("\n"), 1):
        line = line.strip()
        if not line.startswith("{"):
            continue
        try:
            edges.append(_edge(line, meaning))
        except (ValueError, RecursionError) as e:
            errors.append(f"line {n}: {e}")
    if errors and not edges:
        raise AnswerError("; ".join(errors[:ERRORS_SHOWN]))
    return edges


def parse_array(text: str) -> list[tuple]:
    """Edges (FIELDS) of an answer that is a JSON array."""
    try:
        found = json.loads(strip_fence(text))
    except ValueError as e:
        raise AnswerError(str(e)) from e
    if not isinstance(found, list):
        raise AnswerError("not an array")
    if any(not isinstance(x, dict) for x in found):
        raise AnswerError("an element isn't an object")
    return [tuple(str(x.get(f) or "") for f in FIELDS) for x in found]


def extract_edges(code: str, extractor: Extractor) -> list[tuple]:
    """Edges (FIELDS) of one text, from an answer that is a JSON array."""
    ask = "Name the entities of this code and how they relate, as a JSON array of objects with the keys source, source_type, target, target_type and relation_type."
    return parse_array(extractor.complete(f"{ask}\n\n{FENCE}\n{code}\n{FENCE}\n"))


def parse_answers(rows: DataFrame, answer: str = "answer", meaning: str = "meaning") -> DataFrame:
    """Edges of every row's answer; meaning is map<int, struct<chunk_id, file_id>>.
    Answers of which nothing can be used give no rows."""
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for text, known in zip(batch["answer"], batch["meaning"], strict=True):
                known = {int(k): (int(v["chunk_id"]), int(v["file_id"])) for k, v in (known.items() if isinstance(known, dict) else known)}
                try:
                    out += parse_jsonl(text or "", known)
                except AnswerError:
                    continue
            yield pd.DataFrame(out, columns=[*FIELDS, "chunk_id", "file_id"])

    return rows.select(F.col(answer).alias("answer"), F.col(meaning).alias("meaning")).mapInPandas(run, schemas.EDGE)


def parse_array_answers(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """Edges (FIELDS) of every row's answer, a JSON array; answers that are none give no rows."""
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for text in batch["answer"]:
                try:
                    out += parse_array(text or "")
                except AnswerError:
                    continue
            yield pd.DataFrame(out, columns=list(FIELDS))

    return rows.select(F.col(answer).alias("answer")).mapInPandas(run, ", ".join(f"{f} string" for f in FIELDS))


def extract(chunks: DataFrame, extractor: Extractor, batch: int = BATCH) -> DataFrame:
    """Edges of chunks (chunk_id, file_id, path, content_snippet), a prompt for each run
    of `batch` ids, so that prompts are the same whatever the partitions.

    seq is an edge's place in its answer.  A prompt without a usable answer gives a row
    for each of its chunks, with the error and nothing else; the others aren't touched.
    """
    ship(chunks.sparkSession)
    rows = chunks.select("chunk_id", "file_id", "path", "content_snippet", F.floor(F.col("chunk_id") / batch).alias("batch"))
    columns = [*FIELDS, "chunk_id", "file_id", "seq", "error"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_id")
        prompt, meaning = build_prompt(list(pdf[["chunk_id", "file_id", "path", "content_snippet"]].itertuples(index=False, name=None)))
        try:
            found = [(*edge, n, None) for n, edge in enumerate(parse_jsonl(extractor.complete(prompt), meaning))]
        except Exception as e:  # whatever the model raises is this prompt's failure and no other's
            found = [(*[None] * len(FIELDS), *ids, 0, str(e) or type(e).__name__) for ids in meaning.values()]
        return pd.DataFrame(found, columns=columns)

    return rows.groupBy("batch").applyInPandas(run, schemas.RAW_EDGE)


def store_edges(entities: DataFrame, edges: DataFrame, raw: DataFrame, greatest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """entities and edges with the raw edges put in; both ends belong to the edge's chunk.
    Of a source, target and chunk the last line of the answer (seq) stands.  `greatest`:
    the greatest id there is, where `entities` are only those of the chunks."""
    ends = raw.select(F.col("source").alias("name"), F.col("source_type").alias("entity_type"), "chunk_id").union(raw.select("target", "target_type", "chunk_id"))
    after = upsert_entities(entities, ends, greatest)
    a = after.select(F.col("id").alias("source_entity_id"), F.col("name").alias("source"), F.col("entity_type").alias("source_type"), "chunk_id")
    b = after.select(F.col("id").alias("target_entity_id"), F.col("name").alias("target"), F.col("entity_type").alias("target_type"), "chunk_id")
    keyed = raw.join(a, ["source", "source_type", "chunk_id"]).join(b, ["target", "target_type", "chunk_id"])
    return after, upsert_edges(edges, keyed.select("source_entity_id", "target_entity_id", "relation_type", "chunk_id", "seq"))


# Names too common to tell an entity.
COMMON = (
    "main", "init", "New", "Get", "Set", "String", "Error", "Close", "Read", "Write", "Open", "Start", "Stop", "Run",
    "Wait", "int", "string", "bool", "byte", "rune", "error", "true", "false", "nil", "if", "else", "for", "range",
    "return", "func", "var", "const", "type", "struct", "interface", "map", "chan", "go", "defer", "select", "case",
    "default", "break", "continue", "goto", "fallthrough", "import", "package", "Context", "Reader", "Writer",
    "Handler", "Server", "Client", "Request", "Response", "Header", "Body", "Status", "Code", "Time", "Duration",
    "Timeout", "Buffer", "Scanner", "File", "API", "HTTP", "JSON", "XML", "SQL", "DB", "ID", "Key", "Value", "Data",
    "Info", "Config", "Options", "Settings", "Params", "Args", "Flag", "Env",
)


def is_common(name):
    """A column: whether a name is too short or too common to tell an entity, or has no capital."""
    return (F.octet_length(name) < 4) | name.isin(*COMMON) | ~name.rlike("[A-Z]")


def is_capitalized(name):
    """A column: whether a name starts with one of A to Z."""
    return name.rlike("^[A-Z]")


def worth_naming(name):
    """A column: whether a name has four bytes, isn't common and has a capital."""
    return ~is_common(name)


def relations_by_pattern(text: str, pattern: str) -> list[tuple[str, ...]]:
    """Extension: the groups of every match of a pattern in an answer."""
    return [m.groups() for m in re.finditer(pattern, text)]
