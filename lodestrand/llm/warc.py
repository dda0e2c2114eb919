"""WARC archives through a table of chunks.

A payload travels as rows of a record's id and a chunk number, never as a whole:
the writer streams them into archive members, and the reader turns archives back
into such rows, each with the digest of the payload as far as it goes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.common import arrow_rows, partitions, settled, shared_path
from lodestrand.shipping import ship

CHUNK_BYTES = 1 << 16
#: Payloads of fewer bytes are never written as revisits.
MIN_REVISIT = 0
#: Copies from which on a payload's records are told apart by a broadcast table.
HOT = 100_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:lodestrand:record:"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunk_rows(pages: DataFrame, payload: str = "payload", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """pages with chunk_no (from 0), last (boolean) and data (binary) in place of the
    payload; an empty payload is one empty chunk.  A record's rows follow each other.

    The payload is sliced before its rows are made, so that none of them carries it.
    """
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(payload) / chunk_bytes)).cast("int")
    slices = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(payload), i * chunk_bytes + 1, F.lit(chunk_bytes)))
    others = [c for c in pages.columns if c != payload]
    rows = pages.select(*others, n.alias("_n"), F.posexplode(slices).alias("chunk_no", "data"))
    return rows.select(*others, "chunk_no", (F.col("chunk_no") == F.col("_n") - 1).alias("last"), "data")


def _with_digests(batches):
    running, size = hashlib.sha1(), 0
    for batch in batches:
        sizes, found = [], []
        for no, data in arrow_rows(batch, "chunk_no", "data"):
            if no.as_py() == 0:
                running, size = hashlib.sha1(), 0
            piece = data.as_py()
            running.update(piece)
            size += len(piece)
            sizes.append(size)
            found.append(base32(running.digest()))
        yield pa.record_batch([*batch.columns, pa.array(sizes, pa.int64()), pa.array(found, pa.string())], names=[*batch.schema.names, "size_so_far", "digest_so_far"])


def chunk_table(pages: DataFrame, key: str, url: str, html: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The table of chunks, written to the shared folder: rec (a number for each record),
    key, url, chunk_no, last, data, and the payload's size_so_far and digest_so_far."""
    ship(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8")
    rows = pages.select(F.monotonically_increasing_id().alias("rec"), F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload"))
    schema = "rec long, key string, url string, chunk_no int, last boolean, data binary, size_so_far long, digest_so_far string"
    path = shared_path(pages.sparkSession, "chunks")
    chunk_rows(rows, "payload", chunk_bytes).mapInArrow(_with_digests, schema).write.option("compression", "zstd").parquet(path)
    return pages.sparkSession.read.schema(schema).parquet(path)


def decide(digests: DataFrame, min_revisit: int = MIN_REVISIT, key_type: str = "bigint") -> DataFrame:
    """digests (rec, key, payload_bytes, payload_digest and others) with refers_to: the least
    key of those with the same payload.  It is null for the rows of that key, which are
    responses, where no key is known, and where a payload is alone or too short.

    Payloads that HOT or more records have go by a broadcast table, which has no more
    rows than one for every HOT records; so no task gathers all copies of one.
    """
    long = F.col("payload_bytes") >= min_revisit
    same = digests.filter(long).groupBy(F.col("payload_digest").alias("_d"), F.col("payload_bytes").alias("_b")).agg(F.min(F.col("key").cast(key_type)).alias("_least"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    same = settled(same, "copies")
    on = (F.col("payload_digest") == F.col("_d")) & (F.col("payload_bytes") == F.col("_b"))
    hot, rest = F.broadcast(same.filter(F.col("_n") >= HOT)), same.filter(F.col("_n") < HOT)
    joined = digests.join(hot, on).unionByName(digests.join(hot, on, "left_anti").join(rest, on, "left"))
    least = F.col("_least").cast("string")
    return joined.withColumn("refers_to", F.when(~F.col("key").eqNullSafe(least), least)).drop("_d", "_b", "_n", "_least")


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


def record_head(kind: str, key: str | None, url: str | None, size: int, digest: str, refers_to: str | None) -> bytes:
    """A record's headers, and the HTTP headers that stand before its payload."""
    clean = (url or "").replace("\r", "").replace("\n", "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID}{'null' if key is None else key}>"]
    lines += [f"WARC-Target-URI: {clean}", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    lines += [f"Content-Length: {len(http) + (size if kind == 'response' else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _writer(root: str, level: int):
    def run(batches):
        fs, base = _opened(root)
        # A name of its own for each attempt: a task that runs twice leaves two files,
        # and only the one that the finished attempt returns is read.
        path, out, member, n = f"{base}/{uuid.uuid4().hex}.warc.gz", None, None, 0
        try:
            for batch in batches:
                for no, key, url, size, digest, refers, data in arrow_rows(batch, "chunk_no", "key", "url", "payload_bytes", "payload_digest", "refers_to", "data"):
                    if no.as_py() < 0:  # a record's head
                        out = out or fs.open_output_stream(path, compression=None)
                        if member is not None:
                            out.write(member.compress(b"\r\n\r\n") + member.flush())
                        member, kind = zlib.compressobj(level, zlib.DEFLATED, 31), "response" if refers.as_py() is None else "revisit"
                        out.write(member.compress(record_head(kind, key.as_py(), url.as_py(), size.as_py(), digest.as_py(), refers.as_py())))
                        n += 1
                    elif kind == "response":
                        out.write(member.compress(data.as_py()))
            if member is not None:
                out.write(member.compress(b"\r\n\r\n") + member.flush())
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield pa.record_batch([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return run


def write(pages: DataFrame, root: str, key: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT, chunk_bytes: int = CHUNK_BYTES, level: int = 1) -> DataFrame:
    """Writes a record for every row into archives under root, a folder that all
    executors reach; returns path and records of each archive, as a settled table.

    A null html is an empty payload, a payload however long is only ever moved in
    chunks; a null url is an empty one; a null key is written as such and is never
    referred to.  Rows with equal keys and payloads are alike: all responses, or all revisits.
    Other columns aren't read, whatever their names; an empty table gives no archive.
    """
    kind = pages.schema[key].dataType.simpleString()
    chunks = chunk_table(pages, key, url, html, chunk_bytes)
    digests = chunks.filter("last").select("rec", "key", "url", F.col("size_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"))
    heads = decide(digests, min_revisit, kind).withColumn("chunk_no", F.lit(-1))
    # A record's head goes before its chunks; empty ones have nothing to write.
    rows = heads.unionByName(chunks.filter("octet_length(data) > 0").select("rec", "chunk_no", "data"), allowMissingColumns=True)
    rows = rows.repartition(partitions(pages.sparkSession), "rec").sortWithinPartitions("rec", "chunk_no")
    fs, base = _opened(root)
    fs.create_dir(base, recursive=True)
    return settled(rows.mapInArrow(_writer(root, level), "path string, records long"), "archives")


def parse(stream: io.BufferedIOBase, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[dict[str, str], int, bytes, bool]]:
    """Records of an uncompressed WARC stream as (headers, chunk number, data, last);
    headers have names in lower case."""

    def headers() -> dict[str, str]:
        found = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            found[name.strip().lower()] = value.strip()
        return found

    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = headers()
        left = int(head["content-length"])
        if head.get("content-type", "").startswith("application/http"):
            while left > 0:  # the HTTP headers end with an empty line
                line = stream.readline()
                left -= len(line)
                if line in (b"\r\n", b"\n", b""):
                    break
        number = 0
        while True:
            data = stream.read(min(left, chunk_bytes)) if left else b""
            if left and not data:
                raise EOFError("a record ends early")
            left -= len(data)
            yield head, number, data, left == 0
            number += 1
            if not left:
                break


def _reader(root: str, chunk_bytes: int, with_data: bool):
    names = ["key", "record_type", "url", "chunk_no", "last", "size_so_far", "digest_so_far", "payload_bytes", "payload_digest", "refers_to", "data"]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def bare(uri: str | None) -> str | None:
        name = uri and uri.strip("<>").removeprefix(ID)
        return None if name == "null" else name

    def batch(rows):
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches):
        fs, _ = _opened(root)
        for paths in batches:
            for (path,) in arrow_rows(paths, "path"):
                rows, held, running, size = [], 0, hashlib.sha1(), 0
                with fs.open_input_stream(path.as_py(), compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain:
                    for head, no, data, last in parse(io.BufferedReader(plain, chunk_bytes), chunk_bytes):
                        if no == 0:
                            running, size = hashlib.sha1(), 0
                        running.update(data)
                        size += len(data)
                        kind = head["warc-type"]
                        whole = (size, base32(running.digest())) if kind == "response" else (int(head["warc-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:"))
                        if kind == "response" and last and whole != (int(head["warc-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:")):
                            raise ValueError(f"the payload of {head['warc-record-id']} doesn't have its digest")
                        rows.append((bare(head["warc-record-id"]), kind, head.get("warc-target-uri"), no, last, size, base32(running.digest()), *(whole if last else (None, None)), bare(head.get("warc-refers-to")), data if with_data else None))
                        held += len(data) if with_data else 0
                        if held >= 1 << 22 or len(rows) >= 10_000:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return run


def read(archives: DataFrame, root: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk table of archives (path): key, record_type, url, chunk_no, last,
    size_so_far, digest_so_far; with the last chunk payload_bytes and payload_digest
    (a revisit's as its headers have them); refers_to; data (null unless with_data).

    A response whose payload doesn't have the digest in its headers is an error.  A key
    written as null comes back as null; other columns of `archives` aren't read, and an
    empty list of archives gives an empty table.
    """
    ship(archives.sparkSession)
    spread = archives.select("path").repartition(partitions(archives.sparkSession))
    schema = "key string, record_type string, url string, chunk_no int, last boolean, size_so_far long, digest_so_far string, payload_bytes long, payload_digest string, refers_to string, data binary"
    return spread.mapInArrow(_reader(root, chunk_bytes, with_data), schema)


def round_trip(spark: SparkSession, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back: key,
    payload_bytes, payload_digest, record_type, refers_to of each record."""
    root = shared_path(spark, "warc")
    root = root if "://" in root else f"file://{root}" if root.startswith("/") else root.replace("file:/", "file:///", 1)
    kind = pages.schema[key].dataType.simpleString()
    found = read(write(pages, root, key), root, with_data=False).filter("last")
    return found.select(F.col("key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
