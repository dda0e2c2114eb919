"""Substring dedup over words by seed and extend.

Seeds are winnowed anchors that occur more than once in the corpus.  All places of a
seed come together with the words around them, its context: as far as the windows of
`window` words reach that select it.  There each place is extended to both sides.  Places
are grouped by the words to their left, one word more at each step, and sorted within a
group by those to their right, so a place's neighbours are those that agree with it
furthest.  What agrees over the seed and both extensions is a match if it has `window`
words or more.  No pairs are formed.  A seed's matches all hold the seed, so their union
is one stretch, told to the place's document; there stretches that overlap join to
maximal repeats, whose words go, all copies included.

Equal contexts count once: a context that occurs twice matches over all of it.  A seed
that occurs very often in the corpus is lengthened to whole windows, which match if they
occur twice and need no extension.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from lodestrand.llm import anchors as an

WINDOW, GRAM = 35, 12


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def _laid_out(table: pa.Table) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of all texts, their hashes end to end, and where each text begins."""
    words = [t.encode("utf-8", "replace").split() for t in table.column("text").to_pylist()]
    bounds = np.r_[0, np.cumsum([len(w) for w in words], dtype=np.int64)].astype(np.int64)
    return words, word_hashes([w for ws in words for w in ws]), bounds


def _digests(units: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return an.digests(units.tobytes(), begin * 8, end * 8)


def _lengthened(units: np.ndarray, runs: an.Runs, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of runs, each a seed of its own: starts, names and digests."""
    starts = runs.starts()
    digest = _digests(units, starts, starts + window)
    return starts, digest[:, 0] >> np.uint64(64 - an.HASH_BITS), digest


def _seeds(window: int, gram: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, units, bounds = _laid_out(table)
        h, n = np.unique(an.Runs(units, bounds, window, gram).h, return_counts=True)
        return an.parcels([(k, key[0].as_py(), an.pack(h=h[s], n=n[s].astype(np.uint32), marked=n[s] > 1)) for k, s in an.cut(h, buckets)])

    return run


def _send(window: int, gram: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return an.parcels([])
        words, units, bounds = _laid_out(left)
        words = [w for ws in words for w in ws]
        told, parts = an.answered(right)
        runs = an.Runs(units, bounds, window, gram)
        runs = runs.only(an.among(runs.h, told))
        if not len(runs.h):
            return an.parcels([])
        crowded = parts[np.searchsorted(told, runs.h)] > 1
        long, runs = runs.only(crowded), runs.only(~crowded)
        starts, names, whole = _lengthened(units, long, window)
        h, digest = np.r_[runs.h, names], np.concatenate([_digests(units, runs.first, runs.last + window), whole])
        order, head, _ = an.classes(h, digest)
        one = order[head]
        n = np.diff(np.r_[head, len(h)]) > 1
        h, digest = h[one], digest[one]
        of = np.r_[np.zeros(len(runs.h), np.uint64), np.repeat(long.h, long.last - long.first + 1)][one]
        size = np.r_[runs.last - runs.first + window, np.zeros(len(starts), np.int64)][one]
        begin, place = np.r_[runs.first, starts][one], np.r_[runs.place, starts][one]
        rows = []
        for k, s in an.cut(h, buckets):
            body = np.frombuffer(b" ".join([b" ".join(words[a : a + c]) for a, c in zip(begin[s].tolist(), size[s].tolist(), strict=True) if c]), np.uint8)
            rows.append((k, key[0].as_py(), an.pack(h=h[s], digest=digest[s], twice=n[s], of=of[s], size=size[s].astype(np.int32), before=(place - begin)[s].astype(np.int32), body=body)))
        return an.parcels(rows)

    return run


def extended(units: np.ndarray, begin: np.ndarray, size: np.ndarray, before: np.ndarray, seed: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words before and after its seed each context has in the union of its matches
    with other contexts of the seed; -1 if it has no match.

    Context c is units[begin[c]:begin[c] + size[c]] and its seed stands `before[c]` words on.
    """
    reach, n = window - gram, len(begin)
    ids = np.unique(units, return_inverse=True)[1] + 1  # 0 stands for no word
    step = np.arange(reach)[:, None]
    left = np.where(step < before, np.r_[ids, 0][np.where(step < before, begin + before - 1 - step, -1)], 0)
    after = size - before - gram
    right = np.where(step < after, np.r_[ids, 0][np.where(step < after, begin + before + gram + step, -1)], 0)
    rank = np.empty(n, np.int64)
    rank[np.lexsort(right[::-1])] = np.arange(n)
    out_left, out_right = np.full(n, -1), np.full(n, -1)
    rows, group = np.arange(n), seed
    for back in range(reach + 1):
        if back:  # one word more to the left
            more = left[back - 1][rows]
            rows, group, more = rows[more > 0], group[more > 0], more[more > 0]
            group = group.astype(np.uint64) * np.uint64(len(ids) + 1) + more.astype(np.uint64)
        group, size_of = np.unique(group, return_inverse=True, return_counts=True)[1:]
        several = size_of[group] > 1
        rows, group = rows[several], group[several]
        if not len(rows):
            break
        order = np.lexsort((rank[rows], group))
        rows, group = rows[order], group[order]
        pair = np.flatnonzero(group[1:] == group[:-1])
        a, b = rows[pair], rows[pair + 1]
        agree, going = np.zeros(len(a), np.int64), np.arange(len(a))
        for k in range(reach):
            same = (right[k][a[going]] == right[k][b[going]]) & (right[k][a[going]] > 0)
            going = going[same]
            agree[going] += 1
            if not len(going):
                break
        match = back + gram + agree >= window
        for x in (a[match], b[match]):
            out_left[x] = back  # it grows from step to step
            np.maximum.at(out_right, x, agree[match])
    return out_left, out_right


def _extend(window: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        sent = an.unpacked(table)
        who = np.repeat(np.arange(len(sent)), [len(x["h"]) for x in sent])
        h, digest, twice, of, size, before = (np.concatenate([x[c] for x in sent]) for c in ("h", "digest", "twice", "of", "size", "before"))
        order, head, context = an.classes(h, digest)
        one = order[head]
        twice = np.logical_or.reduceat(twice[order], head) | (np.diff(np.r_[head, len(h)]) > 1)
        # A context that occurs twice matches over all of it.
        back, on = np.where(twice, before[one], -1), np.where(twice, size[one] - before[one] - gram, -1)
        of_seed = h[one]
        several = np.r_[False, of_seed[1:] == of_seed[:-1]]
        todo = np.flatnonzero((several | np.r_[several[1:], False]) & (of[one] == 0) & (size[one] > 0))
        if len(todo):
            # Only what is extended is read as words.
            wanted = np.zeros(len(h), bool)
            wanted[one[todo]] = True
            units, done = [], 0
            for x in sent:
                keep = np.repeat(wanted[done : done + len(x["h"])], x["size"])
                done += len(x["h"])
                if keep.any():
                    body = x["body"].tobytes().split(b" ")
                    units.append(word_hashes([body[i] for i in np.flatnonzero(keep).tolist()]))
            # Contexts stand in the order of `sent`; those that are wanted close up.
            starts = np.cumsum(np.where(wanted, size, 0)) - np.where(wanted, size, 0)
            rows = one[todo]
            l, r = extended(np.concatenate(units), starts[rows], size[rows].astype(np.int64), before[rows].astype(np.int64), np.unique(h[rows], return_inverse=True)[1], window, gram)
            back[todo], on[todo] = np.maximum(back[todo], l), np.maximum(on[todo], r)
        told = np.flatnonzero(back[context] >= 0)
        c = context[told]
        return an.by_sender(table, who[told], h=h[told], digest=digest[told, 0], of=of[told], back=back[c].astype(np.int32), on=on[c].astype(np.int32))

    return run


def _matched(units: np.ndarray, runs: an.Runs, right: pa.Table, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the stretches of matched words begin and end, from what a batch was answered."""
    told = an.unpacked(right)
    h, digest, of, back, on = (np.concatenate([x[c] for x in told]) for c in ("h", "digest", "of", "back", "on"))
    plain = of == 0
    mine = runs.only(an.among(runs.h, np.unique(h[plain])))
    row = an.places_of(mine.h, _digests(units, mine.first, mine.last + window)[:, 0], h[plain], digest[plain])
    mine, row = mine.only(row >= 0), row[row >= 0]
    begin, end = mine.place - back[plain][row], mine.place + gram + on[plain][row]
    if plain.all():
        return begin, end
    starts, names, whole = _lengthened(units, runs.only(an.among(runs.h, np.unique(of[~plain]))), window)
    starts = starts[an.places_of(names, whole[:, 0], h[~plain], digest[~plain]) >= 0]
    return np.r_[begin, starts], np.r_[end, starts + window]


def _cut_out(window: int, gram: int, with_text: bool):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        words, units, bounds = _laid_out(left)
        gone = np.zeros(len(units), bool)
        if right.num_rows and len(units) >= window:
            gone = an.covered(*_matched(units, an.Runs(units, bounds, window, gram), right, window, gram), len(units))
        out = []
        for ws, lo, hi in zip(words, bounds.tolist(), bounds[1:].tolist(), strict=False):
            lost = gone[lo:hi]
            kept = b" ".join([w for w, g in zip(ws, lost.tolist(), strict=True) if not g] if lost.any() else ws)
            repeats = int(np.diff(np.r_[0, lost.astype(np.int8)]).clip(0).sum()) if hi > lo else 0
            out.append((hi - lo, int(lost.sum()), repeats, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["n_words", "n_removed", "n_repeats", "kept_sha256", "kept"]
        return pa.table([left.column("key"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["key", *names])

    return run


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row a document: its key, n_words, n_removed, n_repeats (long; maximal runs of
    removed words), kept_sha256, and the kept words joined by spaces (null unless
    with_text).

    A null or empty text has no words; a text however long is read whole, by the one task
    that has its batch.  Repeated rows are documents of their own, so their windows
    repeat; null keys are keys like others.  Other columns aren't read, whatever their
    names; an empty table gives an empty one.
    """
    n = an.width(docs, text)
    batches = an.dealt(docs, key, text, n)
    told = an.grouped(an.grouped(batches, "b", _seeds(window, gram, n), an.PARCEL), "bucket", an.shared_names, an.PARCEL)
    contexts = an.with_answers(batches, told, _send(window, gram, n), an.PARCEL)
    matches = an.grouped(contexts, "bucket", _extend(window, gram), an.PARCEL)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_words long, n_removed long, n_repeats long, kept_sha256 string, kept string"
    return an.with_answers(batches, matches, _cut_out(window, gram, with_text), schema).withColumnRenamed("key", key)
