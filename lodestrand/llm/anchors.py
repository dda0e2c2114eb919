"""Winnowed anchors, and the exchange that finds which of them repeat.

A document is a sequence of units (bytes or words).  Every window of a fixed number
of units selects the least gram within it, so equal windows, wherever they stand,
select equal grams at equal places: an anchor.  Documents are dealt once to batches.
Batches send the hashes of their anchors, packed, to buckets; a bucket tells each
batch which of its anchors others have too.  Only windows of those go further.

What a batch sends has each hash once, so an anchor that a third of all documents
share weighs as much as there are batches.  Batches and buckets are as many as the
text's bytes ask for, whatever the session's width: see width().
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.shipping import ship

#: Anchors travel as so many bits; hashes that collide only cost a closer look.
HASH_BITS = 48
#: Bytes of text of a batch or a bucket at least, and bytes of text for each parcel at least.
LEAST_BYTES, PARCEL_BYTES = 4 << 20, 1 << 10
#: Units that are worked on at once; a place in them takes PLACE_BITS.
PIECE, PLACE_BITS = 1 << 18, 20
#: An anchor that occurs more often is cut into parts of about so many occurrences.
CROWD = 1 << 16
_BASES = (0x9E3779B97F4A7C15 | 5, 0xD1342543DE82EF95, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_NAME = np.uint64(0x8EBC6AF09C88C6E3)
_FIRST = np.zeros(1, np.int64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _running(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse."""
    if base not in _powers or len(_powers[base][0]) < n:
        b, size = _BASES[base], max(n, PIECE + 256)
        up, down = np.full(size, b, np.uint64), np.full(size, pow(b, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        if n > 2 * PIECE:
            return up, down
        _powers[base] = (up, down)
    return _powers[base]


def gram_hashes(units: np.ndarray, size: int, base: int = 0) -> np.ndarray:
    """A hash of each run of `size` units, from differences of one running sum."""
    n = len(units)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _running(base, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(units * up[:n], out=total[1:])
    return mix64((total[size:] - total[:-size]) * down[: n - size + 1])


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values (PIECE and a few at most), the place of its least,
    the first of equals.  Their lowest PLACE_BITS bits don't count."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    value, have = (values & ~low) | np.arange(len(values), dtype=np.uint64), 1
    while have < width:
        step = min(have, width - have)
        value = np.minimum(value[step:], value[:-step])
        have += step
    return (value & low).astype(np.int64)


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] numbers, then those of first[1], ..."""
    if not len(first):
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1])


def heads(changes: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours begins, from where a value differs from the one before."""
    return np.concatenate((_FIRST, np.flatnonzero(changes) + 1))


def lengths(begin: np.ndarray, n: int) -> np.ndarray:
    """The lengths of runs that begin there, the last of which ends at n."""
    out = np.empty(len(begin), np.int64)
    np.subtract(begin[1:], begin[:-1], out=out[:-1])
    out[-1:] = n - begin[-1:]
    return out


class Runs:
    """Windows of documents laid end to end, by the anchor that they select.

    A run is the windows that start at first..last (inclusive) of document doc; they
    select the gram at `place`, and h is that gram's name.  Names are hashes of the
    least hashes: those crowd at the low end, and names don't.
    """

    def __init__(self, units: np.ndarray, bounds: np.ndarray, window: int, gram: int, table: np.ndarray | None = None, base: int = 0):
        """bounds: where each document begins, and the end of the last.  With a table
        units are places in it.  Each base orders grams in its own way."""
        parts = []
        for at in range(0, len(units), PIECE):  # windows that start in this piece
            part = units[at : at + PIECE + window - 1]
            if len(part) < window:
                break
            grams = gram_hashes(part if table is None else table[part], gram, base)
            chosen = least_places(grams, window - gram + 1)
            near = np.arange(*np.searchsorted(bounds, [at, at + len(chosen) + window - 1], "right"))  # documents that end among these windows
            inside = np.ones(len(chosen), bool)
            for end in bounds[near[near < len(bounds)]].tolist():
                inside[max(0, end - window + 1 - at) : max(0, end - at)] = False
            start = np.flatnonzero(inside)
            if not len(start):
                continue
            chosen = chosen[start]
            start += at
            head = np.flatnonzero(np.r_[True, (start[1:] != start[:-1] + 1) | (chosen[1:] != chosen[:-1])])
            last = start[np.r_[head[1:], len(start)] - 1]
            owner = np.searchsorted(bounds, start[head], "right") - 1
            parts.append((start[head], last, mix64(grams[chosen[head]] ^ _NAME) >> np.uint64(64 - HASH_BITS), owner, chosen[head] + at))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.first, self.last, self.h, self.doc, self.place = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else none

    def only(self, keep: np.ndarray) -> Runs:
        out = object.__new__(Runs)
        out.first, out.last, out.h, out.doc, out.place = (x[keep] for x in (self.first, self.last, self.h, self.doc, self.place))
        return out

    def starts(self) -> np.ndarray:
        """The start of every window."""
        return spans(self.first, self.last - self.first + 1)


def digests(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of data[begin:end], as two numbers each."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]), ">u8").astype(np.uint64).reshape(-1, 2)


def classes(h: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by name and digest, where each class of equal ones begins among
    them, and the class of each row."""
    order = np.lexsort((digest[:, 1], digest[:, 0], h))
    a, b = h[order], digest[order]
    head = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]).any(1)] if len(h) else np.zeros(0, bool)
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(head) - 1
    return order, np.flatnonzero(head), number


def part_names(h: np.ndarray, parts: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Names of a crowded anchor's windows: each belongs to the part that its digest tells."""
    return mix64(h ^ mix64(digest % parts.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - HASH_BITS)


def places_of(h: np.ndarray, digest: np.ndarray, known_h: np.ndarray, known_digest: np.ndarray) -> np.ndarray:
    """For each pair its place among the known pairs, or -1."""
    if not len(known_h):
        return np.full(len(h), -1)
    both, known = mix64(h ^ mix64(digest)), mix64(known_h ^ mix64(known_digest))
    order = np.argsort(known)
    at = order[np.minimum(np.searchsorted(known[order], both), len(known) - 1)]
    return np.where((known_h[at] == h) & (known_digest[at] == digest), at, -1)


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n units lie in one of the spans."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(change[:n]) > 0


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as bytes; the sorted one named h goes as differences, byte by byte."""
    if "h" in arrays:
        steps = np.diff(arrays["h"].astype(np.uint64), prepend=np.uint64(0))
        arrays["h"] = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpack(data: bytes) -> dict[str, np.ndarray]:
    arrays = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    if "h" in arrays:
        arrays["h"] = np.cumsum(np.ascontiguousarray(arrays["h"].T).view(np.uint64).reshape(-1))
    return arrays


def unpacked(table: pa.Table) -> list[dict[str, np.ndarray]]:
    return [unpack(x.as_py()) for x in table.column("data")]


def buckets_of(h: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each name; sorted names give sorted buckets."""
    return ((h >> np.uint64(HASH_BITS - 32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


PARCEL = "bucket int, b int, data binary"


def parcels(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "b": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary())})


def cut(h: np.ndarray, n: int) -> list[tuple[int, slice]]:
    """(bucket, slice) for sorted names."""
    at = np.searchsorted(buckets_of(h, n), np.arange(n + 1))
    return [(k, slice(lo, hi)) for k, (lo, hi) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)) if hi > lo]


def by_sender(table: pa.Table, who: np.ndarray, **arrays: np.ndarray) -> pa.Table:
    """Rows (who: the sender that each is for, its own in order of h) as a parcel to each sender."""
    b, bucket = table.column("b").to_pylist(), table.column("bucket")[0].as_py()
    order = np.argsort(who, kind="stable")
    at = np.searchsorted(who[order], np.arange(len(b) + 1))
    mine = [order[at[i] : at[i + 1]] for i in range(len(b))]
    return parcels([(bucket, b[i], pack(**{c: v[rows] for c, v in arrays.items()})) for i, rows in enumerate(mine) if len(rows)])


def width(docs: DataFrame, text: str) -> int:
    """The number of batches, and of buckets, for so many bytes of text.

    A batch or bucket has LEAST_BYTES at least.  As each batch sends a parcel to each
    bucket, both grow with the root of the corpus beyond: then there is one parcel for
    every PARCEL_BYTES of text, at any size, and 100 TB go in batches of 0.3 GB.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string"))).alias("n")).collect()[0]["n"] or 0
    return max(1, -(-total // max(LEAST_BYTES, math.isqrt(PARCEL_BYTES * total))))


def dealt(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """b, key, text: documents dealt to n batches."""
    ship(docs.sparkSession)
    rows = docs.selectExpr(f"`{key}` AS key", f"coalesce(CAST(`{text}` AS STRING), '') AS text")
    return rows.select(F.pmod(F.xxhash64("key", "text"), F.lit(n)).cast("int").alias("b"), "key", "text")


def grouped(df: DataFrame, by: str, fn, schema: str) -> DataFrame:
    return df.groupBy(by).applyInArrow(fn, schema)


def with_answers(batches: DataFrame, answers: DataFrame, fn, schema: str) -> DataFrame:
    """fn(documents of a batch, what was answered to it), for every batch."""
    return batches.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(fn, schema)


def shared_names(table: pa.Table) -> pa.Table:
    """Answers each batch with those of its anchors that another batch has, or that it
    marked itself, and into how many parts each is cut.  Parcels have h, sorted and
    without repeats, n (occurrences) and `marked`."""
    sent = unpacked(table)
    who = np.repeat(np.arange(len(sent)), [len(x["h"]) for x in sent])
    h, n, marked = (np.concatenate([x[c] for x in sent]) for c in ("h", "n", "marked"))
    order = np.argsort(h, kind="stable")
    h, who, n, marked = h[order], who[order], n[order], marked[order]
    head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    size = np.diff(np.r_[head, len(h)])
    parts = np.repeat(np.add.reduceat(n, head, dtype=np.int64) // CROWD + 1, size).astype(np.uint32)
    told = marked | (np.repeat(size, size) > 1)
    return by_sender(table, who[told], h=h[told], parts=parts[told])


def answered(right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The names of all answers to a batch, sorted, and their parts."""
    found = unpacked(right)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    h, parts = (np.concatenate([x[c] for x in found]) for c in ("h", "parts"))
    order = np.argsort(h)
    return h[order], parts[order]
