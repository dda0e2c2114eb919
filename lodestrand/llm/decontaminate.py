"""Benchmark decontamination by SimHash windows as long as the items.

A document's windows of an item's length get SimHash fingerprints.  A multi-index
over blocks of bits finds every item within the radius: of BLOCKS blocks at least one
differs in at most radius // BLOCKS bits.  Items are filed under all values of each block
with half as many bits changed, and looked up under all with the other half changed.  What it finds counts only if the weighted similarity of the shingles
themselves, min over max of their counts, reaches the bound.

Only windows that share a shingle with some item are looked at: the others have
similarity 0.  The benchmark is the stated query set; it goes to the tasks in blocks
of bounded size, and each block sees every document.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.anchors import among, gram_hashes, mix64
from lodestrand.llm.common import arrow_rows
from lodestrand.shipping import ship

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 19
BLOCKS, BLOCK_BITS = 4, 16
#: A block of the benchmark has about this many words and items at most.
BLOCK_WORDS, BLOCK_ITEMS = 2_000_000, 20_000
#: Fingerprints that are looked up at once.
LOOKUP = 4_096


def word_units(text: str) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    words = text.lower().encode("utf-8", "replace").split()
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def shingles(units: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words; of all words if they are fewer."""
    return gram_hashes(units, min(size, len(units))) if len(units) else np.zeros(0, np.uint64)


def votes(hashes: np.ndarray) -> np.ndarray:
    """Running sums, by bit, of +1 and -1 for the bits of each hash."""
    bits = np.unpackbits(mix64(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(2 * bits - 1, axis=0, dtype=np.int32)])


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def weighted_similarity(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


def _changes(flips: int) -> np.ndarray:
    """Every set of at most so many bits of a block."""
    return np.array([sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(BLOCK_BITS), n)], np.int64)


class BenchmarkIndex:
    """Items by length, their fingerprints by blocks of bits, and their shingles."""

    def __init__(self, items: list[tuple[object, str]], size: int = SHINGLE, radius: int = RADIUS):
        self.size, self.radius = size, radius
        units = [(key, word_units(text)) for key, text in items]
        units = [(key, u) for key, u in units if len(u)]
        self.keys = [key for key, _ in units]
        self.words = np.array([len(u) for _, u in units], np.int64)
        found = [shingles(u, size) for _, u in units]
        self.shingles = [Counter(s.tolist()) for s in found]
        self.known = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        self.lengths: dict[int, set[int]] = {}  # of the items with a shingle
        for own, n in zip(self.shingles, self.words.tolist(), strict=True):
            for s in own:
                self.lengths.setdefault(s, set()).add(n)
        self.prints = np.array([packed(votes(s)[-1:])[0] for s in found], np.uint64)
        own = radius // BLOCKS // 2
        near, self.changes = _changes(own), _changes(radius // BLOCKS - own)
        self.files = []
        for block in range(BLOCKS):
            value = (self.prints >> np.uint64(block * BLOCK_BITS)).astype(np.int64) & 0xFFFF
            filed = (value[:, None] ^ near[None]).reshape(-1)
            order = np.argsort(filed, kind="stable")
            self.files.append((np.searchsorted(filed[order], np.arange((1 << BLOCK_BITS) + 1)), (order // len(near)).astype(np.int32)))

    def lookup(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (print, item) within the radius."""
        pairs = [np.zeros(0, np.int64)]
        for first in range(0, len(prints), LOOKUP):
            some = prints[first : first + LOOKUP]
            for block, (at, filed) in enumerate(self.files):
                value = (some >> np.uint64(block * BLOCK_BITS)).astype(np.int64) & 0xFFFF
                value = (value[:, None] ^ self.changes[None]).reshape(-1)
                lo, n = at[value], at[value + 1] - at[value]
                hit = np.flatnonzero(n)
                lo, n, who = lo[hit], n[hit], hit // len(self.changes)
                who = np.repeat(who, n)
                item = filed[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())].astype(np.int64) if len(hit) else np.zeros(0, np.int64)
                near = np.bitwise_count(some[who] ^ self.prints[item]) <= self.radius
                pairs.append((first + who[near]) * len(self.keys) + item[near])
        both = np.unique(np.concatenate(pairs))
        return both // max(1, len(self.keys)), both % max(1, len(self.keys))

    def matches(self, text: str, similarity: float) -> list[tuple[object, float, int, int]]:
        """(item, similarity, first word, words) of the best window for each item that the text holds."""
        units = word_units(text)
        if not len(units) or not len(self.keys):
            return []
        best: dict[int, tuple[float, int, int]] = {}
        grams_of, hits_of = {}, {}
        # Items shorter than a shingle are shingles of their own size.
        for size in {min(self.size, n, len(units)) for n in self.words.tolist()} if self.words.min() < self.size else {min(self.size, len(units))}:
            grams_of[size] = gram_hashes(units, size)
            hits_of[size] = np.flatnonzero(among(grams_of[size], self.known))
        wanted = {(size, min(n, len(units))) for size, hits in hits_of.items() for g in np.unique(grams_of[size][hits]).tolist() for n in self.lengths[g]}
        for size, length in sorted(wanted):
            if size != min(self.size, length):
                continue
            grams, hits = grams_of[size], hits_of[size]
            span = length - size + 1  # shingles of a window
            mark = np.zeros(len(units) - length + 2, np.int32)
            np.add.at(mark, np.maximum(0, hits - span + 1), 1)
            np.add.at(mark, np.minimum(hits, len(units) - length) + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            near = np.zeros(len(grams) + 1, np.int32)
            np.add.at(near, starts, 1)
            np.add.at(near, starts + span, -1)
            inside = np.cumsum(near[:-1]) > 0  # shingles of those windows; votes are summed over them alone
            place = np.cumsum(inside) - 1
            sums = votes(grams[inside])
            prints = packed(sums[place[starts] + span] - sums[place[starts]])
            for w, item in zip(*self.lookup(prints), strict=True):
                if min(self.words[item], len(units)) != length:
                    continue
                start = int(starts[w])
                s = weighted_similarity(Counter(grams[start : start + span].tolist()), self.shingles[item])
                if s >= similarity and (item not in best or s > best[item][0]):
                    best[item] = (s, start, length)
        return [(self.keys[i], *best[i]) for i in sorted(best)]


def blocks(benchmark: DataFrame, key: str, text: str) -> list[list[tuple[object, str]]]:
    """The benchmark in blocks of bounded size, on the driver."""
    size = benchmark.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.split(F.coalesce(text, F.lit("")), r"\s+"))).alias("w")).collect()[0]
    n = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["w"] or 0) // BLOCK_WORDS))
    for k in range(n):
        part = benchmark.filter(F.pmod(F.xxhash64(key, text), F.lit(n)) == k).select(key, text)
        yield [(r[0], r[1] or "") for r in part.collect()]


def _find(index, similarity: float, item_type: pa.DataType):
    names = ["key", "item", "similarity", "first_word", "words"]

    def run(batches):
        for batch in batches:
            rows = [(key.as_py(), *m) for key, text in arrow_rows(batch, "key", "text") for m in index.value.matches(text.as_py() or "", similarity)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [batch.schema.field("key").type, item_type, pa.float64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row for each document and item that it holds: their keys, similarity, and
    where the best window is (first_word, words).

    Letters' case doesn't count.  A document shorter than an item is one window; a long
    one is searched whole.  Null and empty texts hold nothing, and items without words are
    nowhere; null and repeated keys are carried along, and of equally good windows the
    first is told.  Other columns aren't read, whatever their names; where either table
    is empty nothing is found.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship(spark)
    rows = docs.selectExpr(f"`{key}` AS key", f"CAST(`{text}` AS STRING) AS text")
    item_type = benchmark.schema[item].dataType
    schema = f"key {rows.schema['key'].dataType.simpleString()}, item {item_type.simpleString()}, similarity double, first_word long, words long"
    out = None
    for block in blocks(benchmark, item, item_text):
        index = spark.sparkContext.broadcast(BenchmarkIndex(block, size, radius))
        found = rows.mapInArrow(_find(index, similarity, to_arrow_type(item_type)), schema)
        out = found if out is None else out.union(found)
    return out.withColumnsRenamed({"key": key, "item": item})


def _clean(index, similarity: float, text: str):
    def run(batches):
        for batch in batches:
            held = [bool(t.as_py()) and bool(index.value.matches(t.as_py(), similarity)) for (t,) in arrow_rows(batch, text)]
            yield batch.filter(pa.array([not h for h in held], pa.bool_()))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """docs without the documents that hold an item; all columns stay, and no row moves.

    Texts and items count as in find(): null and empty texts stay, repeated rows go or
    stay together, and without items all stay.
    """
    spark = docs.sparkSession
    ship(spark)
    for block in blocks(benchmark, item, item_text):
        index = spark.sparkContext.broadcast(BenchmarkIndex(block, size, radius))
        docs = docs.mapInArrow(_clean(index, similarity, text), docs.schema)
    return docs
