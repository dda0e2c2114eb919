"""Secret scans with structural confirmation.

Plain patterns report what looks like a secret.  Besides, runs of base64 or hex are
decoded and reported only if their bytes parse: as a private key in DER, whose
nested lengths must fit each other, as an OpenSSH private key, whose counted strings
must fit, or as a signed token, whose header must be JSON that names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrand.llm.common import arrow_rows
from lodestrand.shipping import ship

KINDS = ("assign", "access", "hex", "der", "ssh", "token")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
# Runs of these classes are maximal, so asking for the length at once drops what is shorter.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{32,}")
ANY_HEX = re.compile(r"[0-9A-Fa-f]{48,}")
# What starts a key at any offset: 0x30 and a length, or the OpenSSH magic.
BASE64_START = re.compile(r"M[A-I]|b3BlbnNzaC1rZXktdjE")
HEX_START = re.compile(r"30(?:8[1-4]|[0-7])|6[Ff]70656[Ee]7373682[Dd]6[Bb]65792[Dd]7631")
# Lines of a key go on over bare or escaped line ends, indents and spaces.
GAP = r"(?:[ \t]|\r|\n|\\+[rnt])+"
BASE64_MORE, HEX_MORE = re.compile(GAP + r"([A-Za-z0-9+/_-]+)"), re.compile(GAP + r"([0-9A-Fa-f]+)")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*)?")
SSH_MAGIC = b"openssh-key-v1\x00"
SEQUENCE, INTEGER, OCTETS, OBJECT_ID = 0x30, 0x02, 0x04, 0x06


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the DER element at `at`, if it fits before `end`."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
        if n < 0x80:  # DER has one form for each length
            return None
    return (tag, at, at + n) if at + n <= end else None


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill data[start:end] exactly."""
    found = []
    while start < end:
        if (x := _element(data, start, end)) is None:
            return None
        found.append(x)
        start = x[2]
    return found


def der_key_length(data: bytes) -> int:
    """Bytes of the DER private key that data starts with, or 0."""
    top = _element(data, 0, len(data))
    if top is None or top[0] != SEQUENCE or (parts := _children(data, *top[1:])) is None or len(parts) < 2:
        return 0
    tags = [p[0] for p in parts]
    number = int.from_bytes(data[parts[0][1] : parts[0][2]], "big") if tags[0] == INTEGER else -1
    algorithm = lambda p: p[0] == SEQUENCE and bool(x := _children(data, p[1], p[2])) and x[0][0] == OBJECT_ID
    if number in (0, 1) and len(tags) >= 9 and tags[:9] == [INTEGER] * 9:  # RSA: version and eight numbers
        return top[2]
    if number == 0 and tags == [INTEGER] * 6:  # DSA
        return top[2]
    if number in (0, 1) and len(tags) >= 3 and algorithm(parts[1]) and tags[2] == OCTETS:  # PKCS 8
        return top[2]
    if number == 1 and tags[1] == OCTETS and parts[1][2] - parts[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:]):  # elliptic curve
        return top[2]
    if len(tags) == 2 and algorithm(parts[0]) and tags[1] == OCTETS:  # encrypted PKCS 8
        return top[2]
    return 0


def ssh_key_length(data: bytes) -> int:
    """Bytes of the OpenSSH private key that data starts with, or 0."""
    if not data.startswith(SSH_MAGIC):
        return 0
    at = len(SSH_MAGIC)

    def string() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if not string() or not string() or string() is None or at + 4 > len(data):  # cipher, key derivation, its options
        return 0
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 64:
        return 0
    for _ in range(keys):
        public = string()
        if not public or len(public) < 8 or 4 + int.from_bytes(public[:4], "big") > len(public):
            return 0
    return at if string() else 0


def _decoded(run: str) -> bytes:
    run = run.replace("-", "+").replace("_", "/")
    run = run[: len(run) - (len(run) % 4 == 1)]
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4))
    except binascii.Error:
        return b""


def _json(part: str) -> dict | None:
    try:
        found = json.loads(_decoded(part))
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_token(text: str) -> bool:
    parts = text.split(".")
    head = _json(parts[0])
    if head is None or not isinstance(head.get("alg"), str):
        return False
    return isinstance(head.get("enc"), str) if len(parts) == 5 else _json(parts[1]) is not None


def _stated_length(head: bytes) -> int:
    """Bytes of the DER sequence that starts with head, if its first element may be a key's; else 0."""
    if len(head) < 2 or head[0] != SEQUENCE:
        return 0
    at = 2 + (head[1] & 0x7F if head[1] & 0x80 else 0)
    n = int.from_bytes(head[2:at], "big") if at > 2 else head[1]
    return at + n if at < len(head) and head[at] in (INTEGER, SEQUENCE) else 0


def _letters(text: str, start: int, end: int, more: re.Pattern, need: int | None) -> tuple[str, list[tuple[int, int]]]:
    """The letters from start on, over the gaps between lines, and where they are; `need` of them are enough."""
    spans, have = [(start, end)], end - start
    while (need is None or have < need) and (m := more.match(text, end)):
        spans.append(m.span(1))
        end, have = m.end(), have + m.end() - m.start(1)
    return "".join(text[a:b] for a, b in spans)[:need], spans


def confirmed(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans (start, end, kind) whose decoded bytes have a secret's structure."""
    for pieces, starts, more, head, size, decoded in (
        (BASE64, BASE64_START, BASE64_MORE, 12, lambda n: -(-n * 4 // 3), _decoded),
        (ANY_HEX, HEX_START, HEX_MORE, 18, lambda n: 2 * n, lambda run: bytes.fromhex(run[: len(run) - len(run) % 2])),
    ):
        done = 0
        for m in pieces.finditer(text):
            at = max(done, m.start())
            while (start := starts.search(text, at, m.end())) and m.end() - start.start() >= head:
                first, at = start.start(), start.start() + 1
                kind, need = "ssh", None
                if start.group()[0] in "M3":
                    whole = _stated_length(decoded(text[first : first + head]))
                    if not whole:
                        continue
                    kind, need = "der", size(whole)
                run, spans = _letters(text, first, m.end(), more, need)
                if need and len(run) < need:
                    continue
                n = (der_key_length if need else ssh_key_length)(decoded(run))
                if not n:
                    continue
                left = size(n)
                for lo, hi in spans:
                    end = lo + min(left, hi - lo)
                    left -= end - lo
                    if not left:
                        break
                while head == 12 and end < len(text) and text[end] == "=" and end - hi < 2:
                    end += 1
                yield first, end, kind
                done = at = end
    if "eyJ" in text:
        for m in TOKEN.finditer(text):
            if is_token(m.group()):
                yield m.start(), m.end(), "token"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost matches of each plain pattern that don't overlap; those too short are dropped."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def written(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind in the order of KINDS, then end."""
    order = sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in order)


def scan_text(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Spans of the plain patterns, and those that the decoded structure adds."""
    return base_spans(text), list(confirmed(text))


def _scan(batches):
    for batch in batches:
        out = []
        for key, text in arrow_rows(batch, "key", "text"):
            base, more = scan_text(text.as_py() or "")
            counts = [sum(s[2] == k for s in base) for k in KINDS[:3]]
            out.append((key.as_py(), *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(base + more), len(more)))
        columns = list(zip(*out, strict=True)) or [[]] * 7
        types = [batch.schema.field("key").type, *[pa.int64()] * 3, pa.string(), pa.string(), pa.int64()]
        names = ["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: its key, n_assign, n_access, n_hex (long), base_sha256,
    spans (string), n_confirmed (long; spans that decoding adds).

    Offsets are in code points and ends are exclusive.  A null or empty text has no
    span: counts are 0 and spans is empty; a long one is scanned whole.  Spans that
    start together stand in the order of their kinds.  Null and repeated keys give a row
    each.  Other columns aren't read, whatever their names; an empty table gives an empty
    one.  No row moves between tasks.
    """
    ship(docs.sparkSession)
    rows = docs.selectExpr(f"`{key}` AS key", f"CAST(`{text}` AS STRING) AS text")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_scan, f"key {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long").withColumnRenamed("key", key)


def redact(text: str, spans: str, mark: str = "[SECRET]") -> str:
    """The text with each span of `spans` (overlapping ones as one) replaced."""
    out, at = [], 0
    for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def _redact(column: str):
    def run(batches):
        for batch in batches:
            index = batch.schema.get_field_index(column)
            texts = []
            for (value,) in arrow_rows(batch, column):
                text = value.as_py()
                if text:
                    base, more = scan_text(text)
                    text = redact(text, written(base + more)) if base or more else text
                texts.append(text)
            yield batch.set_column(index, batch.schema.field(index), pa.array(texts, batch.schema.field(index).type))

    return run


def redact_docs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of its texts replaced by a mark.

    Null texts stay null and empty ones empty; long ones are scanned whole, repeated rows
    each.  Other columns, whatever their names, come along; an empty table stays empty.
    """
    ship(docs.sparkSession)
    return docs.mapInArrow(_redact(text), docs.schema)
