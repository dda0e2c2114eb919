"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints within the radius agree on at least two of radius + 2 blocks of bits,
so each is filed once under every pair of blocks.  What is filed together is sorted
by Gray rank, which puts fingerprints of few differing bits side by side, and indexed
by a tree whose nodes hold the bits that all below them share.  A search carries the
differences met so far and drops a node, with all below it, once they pass the radius.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import arrow_rows, partitions, settled
from lodestrand.shipping import ship

BITS, RADIUS, SHINGLE, SEED, FANOUT = 64, 4, 4, 42, 8
#: Rows that one step of a search may hold.
FRONTIER = 2_000_000
#: Rows of the sorted file that are gathered before their whole keys are searched, and
#: rows of one key from which on they are filed anew, under more blocks.
GATHER, CROWD = 200_000, 200_000
#: Pairs that are judged at a time, before those that they joined are left out.
JUDGED = 1024


def shingle_hashes(words: list[bytes], size: int, seed: int) -> np.ndarray:
    """XXH64 of each run of `size` words joined by a space; of all words if they are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(0, len(words) - size)
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], seed) for a, b in zip(starts[: last + 1].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)]
    return np.array(found, np.uint64)


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text as an unsigned number; 0 without words."""
    hashes = shingle_hashes(text.encode("utf-8", "replace").lower().split(), size, seed)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def _fingerprints(size: int, seed: int):
    def run(batches):
        for batch in batches:
            found = [fingerprint(t.as_py() or "", size, seed) for (t,) in arrow_rows(batch, "text")]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("key"), pa.array(signed)], names=["key", "fp"])

    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """key, fp (the fingerprint's bits as a signed long) of every document."""
    ship(docs.sparkSession)
    rows = docs.selectExpr(f"`{key}` AS key", f"CAST(`{text}` AS STRING) AS text")
    return rows.mapInArrow(_fingerprints(size, seed), f"key {rows.schema['key'].dataType.simpleString()}, fp long")


def block_keys(fp: Column, radius: int) -> Column:
    """One key for every pair of the radius + 2 blocks of bits: a mask, and the bits in it."""
    edges = [i * BITS // (radius + 2) for i in range(radius + 3)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    pairs = [F.lit(signed(a | b)).cast("long") for a, b in combinations(masks, 2)]
    return F.array(*[F.struct(m.alias("mask"), fp.bitwiseAND(m).alias("bits")) for m in pairs])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each number in Gray-code order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """A tree over numbers, of which those with one group number are searched together.

    levels[0] is the numbers by group and Gray rank; a node of levels[i + 1] stands
    for up to FANOUT neighbours of levels[i] in one group and has the mask of the bits
    in which they agree and those bits.
    """

    def __init__(self, groups: np.ndarray, values: np.ndarray):
        order = np.lexsort((gray_rank(values), groups))
        self.order, self.values = order, values[order]
        group = groups[order]
        self.last = [np.arange(len(values))]
        self.masks, self.patterns = [np.full(len(values), ~np.uint64(0))], [self.values]
        self.first = [np.arange(len(values))]
        ands, ors = self.values, self.values
        while len(group) and (group[1:] == group[:-1]).any():
            begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            place = np.arange(len(group)) - np.repeat(begins, np.diff(np.r_[begins, len(group)]))
            heads = np.flatnonzero(place % FANOUT == 0)
            ands, ors = np.bitwise_and.reduceat(ands, heads), np.bitwise_or.reduceat(ors, heads)
            mask = ~(ands ^ ors)
            self.masks.append(mask)
            self.patterns.append(ands & mask)
            self.first.append(heads)
            self.last.append(self.last[-1][np.r_[heads[1:], len(group)] - 1])
            group = group[heads]
        self.roots = np.searchsorted(self.last[-1], np.arange(len(values)))

    def search(self, queries: np.ndarray, radius: int, labels: np.ndarray | None = None, whole: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs (query, later number) of one group within the radius; None if a step
        outgrows FRONTIER.  With labels, nodes that are wholly of the query's label
        (whole: the label of such nodes, -1 else, by level) are left out."""
        top = len(self.masks) - 1
        q, node = queries, self.roots[queries]
        met = np.bitwise_count((self.values[q] ^ self.patterns[top][node]) & self.masks[top][node]).astype(np.int64)
        for level in range(top, -1, -1):
            if level < top:
                lo = self.first[level + 1][node]
                hi = np.r_[self.first[level + 1][1:], len(self.masks[level])][node]
                count = hi - lo
                if count.sum() > FRONTIER and len(queries) > 1:
                    return None
                above = np.repeat(self.masks[level + 1][node], count)
                q, met = np.repeat(q, count), np.repeat(met, count)
                node = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
                met = met + np.bitwise_count((self.values[q] ^ self.patterns[level][node]) & self.masks[level][node] & ~above)
            keep = (met <= radius) & (self.last[level][node] > q)
            if whole is not None:
                keep &= whole[level][node] != labels[q]
            q, node, met = q[keep], node[keep], met[keep]
        return q, node


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (each the least index of its set), with the sets of each pair joined."""
    while True:
        la, lb = labels[a], labels[b]
        if (la == lb).all():
            return labels
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def group_labels(groups: np.ndarray, values: np.ndarray, radius: int, same=None) -> tuple[np.ndarray, np.ndarray]:
    """The order of the tree, and for each number in it the first that chains of pairs
    within the radius reach in its group.

    With `same` (two arrays of places in `values` to a truth each) only pairs of which
    it is true join.  What a search would find twice is left out and pairs that are
    joined already aren't judged, so a dense group costs about its size and not its square.
    """
    index = GrayIndex(groups, values)
    n = len(values)
    labels = np.arange(n)

    def wholes() -> list[np.ndarray]:
        least, most, out = labels, labels, [labels]
        for heads in index.first[1:]:
            least, most = np.minimum.reduceat(least, heads), np.maximum.reduceat(most, heads)
            out.append(np.where(least == most, least, -1))
        return out

    whole, at, step, fresh = wholes(), 0, 1024, 0
    while at < n:
        found = index.search(np.arange(at, min(n, at + step)), radius, labels, whole)
        if found is None:
            step = max(1, step // 8)
            continue
        at, step = at + step, min(65536, step * 2)
        a, b = found
        while len(a):
            part = len(a) if same is None else JUDGED
            x, y = a[:part], b[:part]
            if same is not None:
                true = same(index.order[x], index.order[y])
                x, y = x[true], y[true]
            labels = merged(labels, x, y)
            fresh += len(x)
            a, b = a[part:], b[part:]
            apart = labels[a] != labels[b]
            a, b = a[apart], b[apart]
        if fresh > n // 16:
            whole, fresh = wholes(), 0
    return index.order, labels


def group_links(groups: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join, within each group, exactly what chains of pairs within the radius join.

    Each number is linked once at most, to the first of its set.
    """
    order, labels = group_labels(groups, values, radius)
    linked = np.flatnonzero(labels != np.arange(len(values)))
    return values[order][linked], values[order][labels[linked]]


def _links(radius: int, crowd: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("mask", pa.int64())])

    def found(x: np.ndarray):
        groups = np.cumsum(np.r_[True, (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])])
        several = np.bincount(groups)[groups] > 1
        a, b = group_links(groups[several], x[2][several].view(np.uint64), radius)
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64())], schema=schema)

    def anew(x: np.ndarray):
        return pa.record_batch([pa.array(x[2]), pa.array(x[2]), pa.array(x[0])], schema=schema)

    def run(batches):
        held, rows, last, passing = [], 0, np.zeros((3, 0), np.int64), None
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "bits", "fp")])
            if passing is not None:  # more of the crowded key
                n = int(np.argmin(np.r_[(x[0] == passing[0]) & (x[1] == passing[1]), False]))
                if n:
                    yield anew(x[:, :n])
                if n == x.shape[1]:
                    continue
                x, passing = x[:, n:], None
            x = np.concatenate([last, x], axis=1)
            if not x.shape[1]:
                continue
            other = np.flatnonzero((x[0] != x[0, -1]) | (x[1] != x[1, -1]))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last key may go on
            held.append(x[:, :cut])
            rows, last = rows + cut, x[:, cut:]
            if last.shape[1] > crowd and can_crowd(int(last[0, 0]), crowd):
                passing = last[:2, 0]
                yield anew(last)
                last = last[:, :0]
            if rows >= GATHER:
                yield found(np.concatenate(held, axis=1))
                held, rows = [], 0
        x = np.concatenate([*held, last], axis=1)
        if x.shape[1]:
            yield found(x)

    return run


def can_crowd(mask: int, crowd: int) -> bool:
    """Whether more than `crowd` numbers can agree in the mask's bits."""
    return 1 << (BITS - (mask & (1 << BITS) - 1).bit_count()) > crowd


def refiled(mask: int, fp: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """Masks that hold `mask` and two of radius + 2 blocks of the other bits, each with the
    numbers' bits in it: numbers within the radius agree in one mask at least."""
    whole = mask & (1 << BITS) - 1
    free = np.array_split([b for b in range(BITS) if not whole >> b & 1], radius + 2)
    blocks = [sum(1 << int(b) for b in part) for part in free]
    out = []
    for a, b in combinations(blocks, 2):
        more = np.array([whole | a | b], np.uint64).view(np.int64)[0]
        out.append((int(more), fp & more))
    return out


def _refile(radius: int):
    def run(batches):
        for batch in batches:
            mask, fp = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "a"))
            for m in np.unique(mask).tolist():
                own = fp[mask == m]
                for more, bits in refiled(m, own, radius):
                    yield pa.record_batch([pa.array(np.full(len(own), more)), pa.array(bits), pa.array(own)], names=["mask", "bits", "fp"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """a, b (long): links between distinct fingerprints fp that join what chains of
    pairs within the radius join.

    A task holds `crowd` fingerprints of a key at most.  The keys that have more come back
    and are filed anew under two blocks more, which loses no pair, until none has.
    """
    spark = distinct.sparkSession
    ship(spark)
    filed = distinct.select("fp", F.explode(block_keys(F.col("fp"), radius)).alias("k")).select("k.mask", "k.bits", "fp")
    out = None
    while True:
        filed = filed.repartition(partitions(spark), "mask", "bits").sortWithinPartitions("mask", "bits")
        found = settled(filed.mapInArrow(_links(radius, crowd), "a long, b long, mask long"), "links")
        linked, crowded = found.filter("mask IS NULL").select("a", "b"), found.filter("mask IS NOT NULL").select("a", "mask")
        out = linked if out is None else out.union(linked)
        if crowded.isEmpty():
            return out.distinct()
        filed = crowded.mapInArrow(_refile(radius), "mask long, bits long, fp long")


def _topmost(parents: DataFrame) -> DataFrame:
    """node, root (long): of nodes and their parents (root, a lesser node each), the last
    of those above a node.  Each pass doubles the steps that a node has gone."""
    while True:
        up = parents.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        step = parents.join(up, F.col("root") == F.col("_n"), "left")
        step = settled(step.select("node", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "above")
        parents = step.select("node", "root")
        if step.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """node, root (long): for each end of the edges (a, b), the least node it reaches.

    Each round hangs every node that has a lesser neighbour under the least of them, puts
    the top of each tree that comes of it in place of all its nodes and drops the edges
    that are within one tree or there twice.  So edges are joined again only while they
    lead from tree to tree, and not in each round: of a dense group hardly any is left after
    the first.  Two rounds at least halve the nodes that have an edge.  Every round
    is written to the shared folder.  Joins have one row a node on one side, so Spark
    splits a hub's rows on the other.
    """
    between = settled(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = between.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    while not between.isEmpty():
        tops = _topmost(between.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
        low, high = tops.select(F.col("node").alias("_n"), F.col("root").alias("_r")), tops.select(F.col("node").alias("_m"), F.col("root").alias("_s"))
        labels = settled(labels.join(low, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), "labels")
        moved = between.join(low, F.col("a") == F.col("_n")).filter("_r <> b")
        moved = moved.join(high, F.col("b") == F.col("_m"), "left").select("_r", F.coalesce("_s", "b").alias("_s")).filter("_r <> _s")
        between = settled(moved.select(F.greatest("_r", "_s").alias("a"), F.least("_r", "_s").alias("b")).distinct(), "edges")
    return labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One row a document: its key, fingerprint (16 hexadecimal digits) and
    component_id, the least key that links of at most `radius` bits reach.

    Texts are lower-cased in A-Z; shingles are of `size` words.  A null text is an
    empty one; texts without words have fingerprint zero and link like any other; a long
    text counts whole.  Repeated rows give a row each.  A null key is never the least; a
    component of null keys alone has a null id.  Other columns aren't read, whatever
    their names; an empty table gives an empty one.
    """
    prints = settled(fingerprints(docs, key, text, size, seed), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("key").alias("least"))
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    named = rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    out = prints.join(named, F.col("fp") == F.col("f"))
    return out.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
