"""Schemas of the engine's tables."""

from __future__ import annotations

SCHEMA_VERSION = "2.4.0"
META = "key string, value string"
FILES = "id long, path string, last_mod_time long, content_hash string, indexed_at timestamp, status string, error_message string, retry_count int, queued_at timestamp"
CHUNKS = "chunk_id long, file_id long, content_snippet string, start_line int, end_line int, embedding array<float>"
ENTITIES = "id long, name string, entity_type string, chunk_id long"
EDGES = "source_entity_id long, target_entity_id long, relation_type string, chunk_id long, weight double"
STATE = "chunk_id long, graph_extracted boolean, extracted_at timestamp"
TABLES = {"meta": META, "files": FILES, "chunks": CHUNKS, "entities": ENTITIES, "edges": EDGES, "state": STATE}
#: What a row of each table is known by: a change replaces all rows of its key.
KEYS = {"meta": ["key"], "files": ["id"], "chunks": ["file_id"], "entities": ["id"], "edges": ["source_entity_id", "target_entity_id", "chunk_id"], "state": ["chunk_id"]}
#: Columns that older stores' files tables lack, with their values.
QUEUE_COLUMNS = {"status": ("string", "indexed"), "error_message": ("string", None), "retry_count": ("int", 0), "queued_at": ("timestamp", None)}
EDGE = "source string, source_type string, target string, target_type string, relation_type string, chunk_id long, file_id long"
#: Raw edges with their place in the answer, or what went wrong with their chunk.
RAW_EDGE = f"{EDGE}, seq int, error string"
EVENTS = "path string, op string, ts timestamp"
