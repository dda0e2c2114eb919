"""Near duplicates by the exact similarity of shingle sets.

Texts of one shingle set are one.  Of each set the least hashes under many orders are
taken, and sets are filed under KEYS keys of ROWS such hashes.  What is filed together
is searched by the Gray-order tree of simhash, at a radius that a pair at the bound
almost never passes.  Links are candidates alone: the sets that chains of them join
come together with their texts, where the tree is searched again and a pair joins
only if its shared shingles reach the bound.

A family of very many sets isn't brought together.  Its members are compared, where they
are, with one of them; those that reach the bound have joined, and only the others go on,
with those of the joined that may be like one of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm.common import arrow_rows, free_name, partitions, settled
from lodestrand.llm.simhash import BITS, GATHER, components, group_labels, shingle_hashes
from lodestrand.shipping import ship

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: At a similarity of 0.8 a pair has no key in common with a chance of 3e-5
#: ((1 - 0.8 ** ROWS) ** KEYS), and passes RADIUS with one of about 4e-5.
KEYS, ROWS, RADIUS = 20, 4, 22
#: Sets of one key, or of one family, that a task holds.
CROWD = 50_000
_draw = np.random.default_rng(SEED)
ORDERS = _draw.integers(0, 1 << 63, (2, KEYS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; letters A-Z count as a-z."""
    return np.unique(shingle_hashes(text.encode("utf-8", "replace").lower().split(), size, seed))


def set_print(hashes: np.ndarray) -> int:
    """The SimHash of a set, each shingle counted once; 0 if it is empty."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def file_keys(hashes: np.ndarray) -> np.ndarray:
    """KEYS numbers, each of the least hashes under ROWS orders; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(KEYS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, ((hashes[at : at + (1 << 12)] ^ ORDERS[0]) * ORDERS[1]).min(1))
    out = np.zeros(KEYS, np.uint64)
    for row in least.reshape(KEYS, ROWS).T:
        out = (out ^ row) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes of all hashes of two sorted sets; of two empty ones 1."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def _sketches(text: str, names: list[str], size: int, seed: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py() or "", size, seed) for (t,) in arrow_rows(batch, text)]
            more = [
                pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array(np.array([set_print(s) for s in sets], np.uint64).view(np.int64)),
                pa.array([file_keys(s).view(np.int64) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.record_batch([*batch.columns, *more], names=[*batch.schema.names, *names])

    return run


def _candidates(radius: int, crowd: int):
    def found(x: np.ndarray):
        key, fp, rep = x
        groups = np.cumsum(np.r_[True, key[1:] != key[:-1]])
        several = np.bincount(groups)[groups] > 1
        order, labels = group_labels(groups[several], fp[several].view(np.uint64), radius)
        node = rep[several][order]
        linked = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.record_batch([pa.array(node[linked]), pa.array(node[labels[linked]])], names=["a", "b"])

    def star(nodes: np.ndarray, centre: int):
        return pa.record_batch([pa.array(nodes), pa.array(np.full(len(nodes), centre))], names=["a", "b"])

    def run(batches):
        held, rows, last, centre = [], 0, np.zeros((3, 0), np.int64), None
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "fp", "rep")])
            if centre is not None:  # more of a crowded key: all its sets are candidates of its first
                n = int(np.argmin(np.r_[x[0] == centre[0], False]))
                if n:
                    yield star(x[2, :n], centre[1])
                if n == x.shape[1]:
                    continue
                x, centre = x[:, n:], None
            x = np.concatenate([last, x], axis=1)
            if not x.shape[1]:
                continue
            other = np.flatnonzero(x[0] != x[0, -1])
            cut = int(other[-1]) + 1 if len(other) else 0  # the last key may go on
            held.append(x[:, :cut])
            rows, last = rows + cut, x[:, cut:]
            if last.shape[1] > crowd:
                centre = (int(last[0, 0]), int(last[2, 0]))
                yield star(last[2, 1:], centre[1])
                last = last[:, :0]
            if rows >= GATHER:
                yield found(np.concatenate(held, axis=1))
                held, rows = [], 0
        x = np.concatenate([*held, last], axis=1)
        if x.shape[1]:
            yield found(x)

    return run


def _against(pivots, size: int, seed: int, similarity: float):
    """Whether each set reaches the similarity with its family's pivot."""

    def run(batches):
        for batch in batches:
            same = [similarity_of(shingle_set(text.as_py() or "", size, seed), pivots.value[root.as_py()]) >= similarity for root, text in arrow_rows(batch, "root", "text")]
            yield pa.record_batch([*batch.columns, pa.array(same, pa.bool_())], names=[*batch.schema.names, "same"])

    return run


def _within(prints, radius: int):
    """The rows within the radius of one of their family's prints."""

    def run(batches):
        for batch in batches:
            near = [bool((np.bitwise_count(prints.value[root.as_py()] ^ np.uint64(fp.as_py() & (1 << BITS) - 1)) <= radius).any()) if root.as_py() in prints.value else False for root, fp in arrow_rows(batch, "root", "fp")]
            yield batch.filter(pa.array(near, pa.bool_()))

    return run


def _spread(near: DataFrame, big: DataFrame, size: int, seed: int, similarity: float, radius: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Of families in `big` (root): node and joined of what is like the family's pivot, and
    the rows that must still be compared with each other.

    No more than one text a family goes to the driver, and families are at most one for
    every `crowd` sets; the prints of the rows that go on are sent out only if they are few.
    """
    spark = near.sparkSession
    rows = settled(near.join(F.broadcast(big), "root", "left_semi"), "families")
    pivots = {r["root"]: shingle_set(r["text"] or "", size, seed) for r in rows.filter("row = root").select("root", "text").collect()}
    told = rows.mapInArrow(_against(spark.sparkContext.broadcast(pivots), size, seed, similarity), T.StructType([*rows.schema, T.StructField("same", T.BooleanType())]))
    told = settled(told, "compared")
    same, others = told.filter("same").drop("same"), told.filter("NOT same").drop("same")
    if others.limit(crowd + 1).count() <= crowd:
        prints: dict[int, list[int]] = {}
        for r in others.select("root", "fp").distinct().collect():  # `crowd` at most
            prints.setdefault(r["root"], []).append(r["fp"])
        sent = spark.sparkContext.broadcast({k: np.array(v, np.int64).view(np.uint64) for k, v in prints.items()})
        on = same.mapInArrow(_within(sent, radius), same.schema)
    else:
        on = same
    return same.select(F.col("row").alias("node"), F.col("root").alias("joined")), others.unionByName(on)


def verified_labels(prints: np.ndarray, sets: list[np.ndarray], similarity: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As group_labels, of one group whose pairs must reach the similarity."""

    def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = sets[i], sets[j]
            out[k] = min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9 and similarity_of(x, y) >= similarity
        return out

    return group_labels(np.zeros(len(prints), np.int64), prints, radius, same)


def _verify(size: int, seed: int, similarity: float, radius: int):
    def judged(held):
        nodes, prints = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
        order, labels = verified_labels(prints.view(np.uint64), [h[2] for h in held], similarity, radius)
        node = nodes[order]
        return pa.record_batch([pa.array(node), pa.array(node[labels])], names=["node", "joined"])

    def run(batches):
        held, current = [], None
        for batch in batches:
            for root, row, fp, text in arrow_rows(batch, "root", "row", "fp", "text"):
                if held and root.as_py() != current:
                    yield judged(held)
                    held = []
                current = root.as_py()
                held.append((row.as_py(), fp.as_py(), shingle_set(text.as_py() or "", size, seed)))
        if held:
            yield judged(held)

    return run


def grouped(docs: DataFrame, text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, seed: int = SEED, crowd: int = CROWD) -> tuple[DataFrame, DataFrame, str]:
    """docs with a number for each row; _r, _g (that number, and the number of the
    row's group); and the name of the column with the number.

    A group is what chains of pairs join whose sets of `size`-word shingles have at
    least this similarity (shared of all).  A text shorter than a shingle is one
    shingle, a long one counts whole; null and empty texts are alike and like nothing
    else.  Repeated rows are one set.  Other columns, whatever their names, come along
    unread, and an empty table has no groups.
    """
    spark = docs.sparkSession
    ship(spark)
    row, whole, print_, keys = free_name(docs, "_row", "_set", "_print", "_keys")
    added = [whole, print_, keys]
    schema = T.StructType([*docs.schema, T.StructField(whole, T.BinaryType()), T.StructField(print_, T.LongType()), T.StructField(keys, T.ArrayType(T.LongType()))])
    rows = docs.mapInArrow(_sketches(text, added, size, seed), schema)
    rows = settled(rows.withColumn(row, F.monotonically_increasing_id()), "sketches")
    reps = rows.groupBy(whole).agg(F.min(row).alias("rep"), F.first(print_).alias("fp"), F.first(keys).alias("keys"))
    reps = settled(reps, "sets")
    filed = reps.select("fp", "rep", F.posexplode("keys").alias("n", "k")).select(F.xxhash64("n", "k").alias("key"), "fp", "rep")
    filed = filed.repartition(partitions(spark), "key").sortWithinPartitions("key")
    links = filed.mapInArrow(_candidates(radius, crowd), "a long, b long").distinct()
    roots = components(links)
    near = rows.select(F.col(row).alias("row"), F.col(print_).alias("fp"), F.col(f"`{text}`").cast("string").alias("text")).join(roots, F.col("row") == F.col("node"))
    near = near.select("root", "row", "fp", "text")
    big = settled(roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("root"), "big")
    pivoted = None
    if not big.isEmpty():
        pivoted, more = _spread(near, big, size, seed, similarity, radius, crowd)
        near = near.join(F.broadcast(big), "root", "left_anti").select("root", "row", "fp", "text").unionByName(more)
    near = near.repartition(partitions(spark), "root").sortWithinPartitions("root")
    joined = settled(near.mapInArrow(_verify(size, seed, similarity, radius), "node long, joined long"), "verified")
    if pivoted is not None:
        ends = joined.unionByName(pivoted).select(F.col("node").alias("a"), F.col("joined").alias("b"))
        joined = components(ends).select("node", F.col("root").alias("joined"))
    named = reps.select(F.col(whole).alias("_s"), "rep").join(joined, F.col("rep") == F.col("node"), "left").select("_s", F.coalesce("joined", "rep").alias("_g"))
    of_rows = rows.select(F.col(row).alias("_r"), whole).join(named, F.col(whole) == F.col("_s")).select("_r", "_g")
    return rows.drop(*added), of_rows, row
