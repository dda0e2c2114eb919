"""The operators bound to the tables of a data directory, and their SQL.

Each query runs its operator with production parameters over its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrand.llm import decontaminate, mixing, pii, quality_cnn, quality_rules, secrets, simhash, substring_dedup, suffix_dedup, warc
from lodestrand.llm.common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_cnn.score(docs, quality_cnn.fit(docs, table(spark, sf_dir, "labels")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept")


#: A string of 50 bytes is compared as five keys of ten.
OP3_SQL = r"""
WITH b AS (
  SELECT doc_id, unnest(regexp_extract_all(hex(encode(coalesce(text, ''))), '..')) AS byte, unnest(range(0, octet_length(encode(coalesce(text, ''))))) AS pos
  FROM documents
), tens AS (
  SELECT *, byte || lead(byte, 1) OVER o || lead(byte, 2) OVER o || lead(byte, 3) OVER o || lead(byte, 4) OVER o
            || lead(byte, 5) OVER o || lead(byte, 6) OVER o || lead(byte, 7) OVER o || lead(byte, 8) OVER o || lead(byte, 9) OVER o AS k
  FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), strings AS (
  SELECT doc_id, pos, byte, k, lead(k, 10) OVER o AS k10, lead(k, 20) OVER o AS k20, lead(k, 30) OVER o AS k30, lead(k, 40) OVER o AS k40
  FROM tens WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), judged AS (
  SELECT doc_id, pos, byte, k40 IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY k, k10, k20, k30, k40) AS seen FROM strings
), covered AS (
  SELECT doc_id, pos, byte, bool_or(seen) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM judged
), edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM covered
), kept AS (
  SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY pos) FILTER (NOT gone) AS rest
  FROM edges GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, ''))) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         3 * source_size AS cap
  FROM s
), r AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS share
  FROM w WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, cap * share <= rest * weight AS stops FROM r
), t AS (
  SELECT source, source_size,
         CASE WHEN stops THEN cap::DOUBLE
              ELSE weight * (max(rest) FILTER (NOT stops) OVER ())::DOUBLE / max(share) FILTER (NOT stops) OVER () END AS target
  FROM c
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM p
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept")


#: A window of 35 words is compared as five keys of seven.
OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS word,
         unnest(range(1, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1)) AS pos
  FROM documents
), sevens AS (
  SELECT *, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o
            || ' ' || lead(word, 4) OVER o || ' ' || lead(word, 5) OVER o || ' ' || lead(word, 6) OVER o AS k
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), windows AS (
  SELECT doc_id, pos, word, k, lead(k, 7) OVER o AS k7, lead(k, 14) OVER o AS k14, lead(k, 21) OVER o AS k21, lead(k, 28) OVER o AS k28
  FROM sevens WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), judged AS (
  SELECT doc_id, pos, word, k28 IS NOT NULL AND count(*) OVER (PARTITION BY k, k7, k14, k21, k28) > 1 AS repeats FROM windows
), covered AS (
  SELECT doc_id, pos, word, bool_or(repeats) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM judged
), edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM covered
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_repeats, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS rest
  FROM edges GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_repeats, 0)::BIGINT AS n_repeats, sha256(coalesce(rest, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), bits AS (
  SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS least,
         list_transform(range(0, 20), lambda i: ((instr('0123456789abcdef', substr(h, 2 * i::INT + 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, 2 * i::INT + 2, 1)) - 1)::BIGINT) AS b
  FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((b[(5 * k // 8)::INT + 1] * 256 + coalesce(b[(5 * k // 8)::INT + 2], 0)) >> (11 - 5 * k % 8)::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN least = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN least = page_id THEN NULL ELSE least END AS refers_to
FROM bits
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trusted = quality_rules.trusted_ids(labels)
    model = quality_rules.fit(docs, trusted)
    threshold = quality_rules.calibrate(docs, trusted, model)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"]
    return quality_rules.assess(docs.select("doc_id", "text"), model, threshold=threshold).select(*columns)


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_quality_cnn": op2_quality_cnn,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_mixing": op4_mixing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_pii": op7_pii,
    "op8_warc": op8_warc,
    "op9_simhash": op9_simhash,
    "op10_quality_rules": op10_quality_rules,
}
ORACLES = {"op3_suffix_dedup": OP3_SQL, "op4_mixing": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op8_warc": OP8_SQL}
