"""Exact substring dedup over bytes by suffix arrays in linear grouping order.

A byte goes if it lies in a string of `window` bytes that also starts in a document
of a smaller id.  Anchors that several documents have bring the texts around them
together; the contexts of one anchor are laid end to end and their suffixes sorted,
so that equal strings become neighbours and each learns the least document it is in.

Suffixes are sorted by grouping.  Groups hold suffixes of one Lyndon prefix.  They are
taken from the greatest down: each member's previous smaller suffix, found through
pointers, takes the member's prefix as its own next piece, so these move to new groups
behind their old ones, by how many members point to them.  When all groups are done,
one pass over the order as it arises emits each group's suffixes, by the order of the
next smaller suffix.  Nothing is renamed and sorted again.  Many short texts are taken
through these steps at once.

Equal contexts of an anchor count once.  An anchor with more than CONTEXTS others is cut
up by further anchors within them, twice at most, and then by single windows, so that
each suffix array stays short.  An anchor that occurs very often in the corpus is cut
into parts by its windows' digests before they are sent.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrand.llm import anchors as an
from lodestrand.llm.anchors import heads, lengths, spans
from lodestrand.llm.common import NULL_ID

WINDOW, GRAM = 50, 20
#: Distinct contexts that one suffix array holds, and how often a crowded anchor's
#: contexts are cut by further anchors before they are cut into windows.
CONTEXTS, LEVELS = 16, 2
#: Symbols that are sorted at once.
SORT_AT_ONCE = 1 << 19
_UNITS = an.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffix arrays of many texts, end to end, as places in `symbols`.

    Text t is symbols[bounds[t]:bounds[t + 1]] and ends with a symbol less than all
    its others.
    """
    n, begin, end = len(symbols), bounds[:-1], bounds[1:]
    owner = np.repeat(np.arange(len(begin)), end - begin)
    order = np.lexsort((symbols, owner))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    head = np.r_[True, (symbols[order][1:] != symbols[order][:-1]) | (owner[order][1:] != owner[order][:-1])] if n else np.zeros(0, bool)
    begins = np.flatnonzero(head)
    group = np.empty(n, np.int64)  # where each suffix's group begins in the order
    group[order] = np.repeat(begins, lengths(begins, n))
    group_end = np.zeros(n, np.int64)
    group_end[begins] = np.r_[begins[1:], n]
    smaller = np.arange(-1, n - 1)  # the previous smaller suffix, as far as it is known
    smaller[begin] = -1
    vacated, wanted = np.zeros(n, bool), np.zeros(n, bool)

    top, low = end.copy(), begin
    while len(top):
        start = group[order[top - 1]]
        count = top - start
        members, bar = order[spans(start, count)], np.repeat(start, count)
        pointer, todo = smaller[members], np.arange(len(members))
        while len(todo):
            p = pointer[todo]
            todo = todo[(p >= 0) & (group[p] >= bar[todo])]
            pointer[todo] = smaller[pointer[todo]]
            smaller[members[todo]] = pointer[todo]
        hit = np.sort(pointer[pointer >= 0])
        if len(hit):
            at = heads(hit[1:] != hit[:-1])
            moved, times = hit[at], lengths(at, len(hit))
            by = np.lexsort((times, group[moved]))
            moved, times, old = moved[by], times[by], group[moved][by]
            at = heads(old[1:] != old[:-1])
            size = lengths(at, len(old))
            target, source = spans(group_end[old[at]] - size, size), place[moved]
            vacated[source], wanted[target] = True, True
            stay, gap = order[target[~vacated[target]]], np.sort(source[~wanted[source]])
            vacated[source], wanted[target] = False, False
            order[gap], place[stay] = stay, gap
            order[target], place[moved] = moved, target
            group_end[old[at]] -= size
            at = heads((old[1:] != old[:-1]) | (times[1:] != times[:-1]))
            size = lengths(at, len(old))
            group[moved] = np.repeat(target[at], size)
            group_end[target[at]] = target[at] + size
        going = start > low
        top, low = start[going], low[going]

    out, fill = np.empty(n, np.int64), np.arange(n)
    out[begin] = end - 1
    live, step = np.arange(len(begin)), 0
    while len(live := live[begin[live] + step < end[live]]):
        i = out[begin[live] + step]
        stop, j = smaller[i], np.where(i > begin[live], i - 1, -1)
        while True:  # the suffixes whose next smaller suffix is i
            go = (j >= 0) & (j != stop)
            if not go.any():
                break
            j, stop = j[go], stop[go]
            g = group[j]
            out[fill[g]] = j
            fill[g] += 1
            j = smaller[j]
        step += 1
    return out


def _laid_out(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, where each begins, and their keys as numbers."""
    data = [t.encode("utf-8", "replace") for t in table.column("text").to_pylist()]
    bounds = np.r_[0, np.cumsum([len(d) for d in data], dtype=np.int64)].astype(np.int64)
    keys = np.array([NULL_ID if k is None else k for k in table.column("key").to_pylist()], np.int64)
    return np.frombuffer(b"".join(data), np.uint8), bounds, keys


def _runs(data: np.ndarray, bounds: np.ndarray, window: int, gram: int, base: int = 0) -> an.Runs:
    return an.Runs(data, bounds, window, gram, _UNITS, base)


def _seeds(window: int, gram: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        data, bounds, keys = _laid_out(table)
        runs = _runs(data, bounds, window, gram)
        order = np.argsort(runs.h, kind="stable")
        h, doc = runs.h[order], keys[runs.doc[order]]
        if not len(h):
            return an.parcels([])
        head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        several = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)
        h, n = h[head], np.diff(np.r_[head, len(h)]).astype(np.uint32)
        return an.parcels([(k, key[0].as_py(), an.pack(h=h[s], n=n[s], marked=several[s])) for k, s in an.cut(h, buckets)])

    return run


class _Windows:
    """The windows of crowded anchors' distinct contexts, each known by its part and digest."""

    def __init__(self, raw: bytes, begin: np.ndarray, size: np.ndarray, h: np.ndarray, parts: np.ndarray, window: int):
        count = size - window + 1
        self.at = np.r_[0, np.cumsum(count)]
        self.start = spans(begin, count)
        self.digest = an.digests(raw, self.start, self.start + window)
        self.h = an.part_names(np.repeat(h, count), np.repeat(parts, count), self.digest[:, 0])


def _send(window: int, gram: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return an.parcels([])
        data, bounds, keys = _laid_out(left)
        raw = data.tobytes()
        runs = _runs(data, bounds, window, gram)
        told, parts = an.answered(right)
        runs = runs.only(an.among(runs.h, told))
        if not len(runs.h):
            return an.parcels([])
        digest = an.digests(raw, runs.first, runs.last + window)
        order, head, _ = an.classes(runs.h, digest)
        doc, one = keys[runs.doc[order]], order[head]
        h, begin, size = runs.h[one], runs.first[one], (runs.last - runs.first)[one] + window
        least, most = np.minimum.reduceat(doc, head), np.maximum.reduceat(doc, head)
        parts = parts[np.searchsorted(told, h)]
        of, crowded = np.zeros(len(h), np.uint64), parts > 1
        if crowded.any():
            # Of a crowded anchor windows go one by one, to the part that each belongs to.
            w = _Windows(raw, begin[crowded], size[crowded], h[crowded], parts[crowded], window)
            n = np.diff(w.at)
            order, head, _ = an.classes(w.h, w.digest)
            one, low, high = order[head], np.repeat(least[crowded], n)[order], np.repeat(most[crowded], n)[order]
            whole = [
                (h, w.h[one]), (begin, w.start[one]), (size, np.full(len(one), window)), (least, np.minimum.reduceat(low, head)),
                (most, np.maximum.reduceat(high, head)), (of, np.repeat(h[crowded], n)[one]), (parts, np.repeat(parts[crowded], n)[one]),
            ]
            h, begin, size, least, most, of, parts = (np.concatenate([a[~crowded], b]) for a, b in whole)
            order = np.argsort(h, kind="stable")
            h, begin, size, least, most, of, parts = (x[order] for x in (h, begin, size, least, most, of, parts))
        rows = []
        for k, s in an.cut(h, buckets):
            body = data[spans(begin[s], size[s])]
            rows.append((k, key[0].as_py(), an.pack(h=h[s], least=least[s], most=most[s], of=of[s], parts=parts[s], size=size[s].astype(np.uint8 if window < 100 else np.int32), body=body)))
        return an.parcels(rows)

    return run


def class_least(texts: np.ndarray, begin: np.ndarray, size: np.ndarray, least: np.ndarray, text_of: np.ndarray, window: int) -> np.ndarray:
    """For each window of each context, the least of `least` over the contexts of its
    text with an equal window.

    Context c is texts[begin[c]:begin[c] + size[c]]; contexts of one text (text_of,
    ascending) are compared.  Windows come in order of context and start.
    """
    count = size - window + 1
    total = np.r_[0, np.cumsum(count)]
    out = np.repeat(least, count)
    firsts = heads(text_of[1:] != text_of[:-1])
    members = lengths(firsts, len(text_of))
    length = np.add.reduceat(size + 1, firsts)
    by_length = np.argsort(length, kind="stable")  # texts that are sorted at once are about as long
    batch = np.cumsum(length[by_length]) // SORT_AT_ONCE
    for k in np.unique(batch):
        chosen = by_length[batch == k]
        context = spans(firsts[chosen], members[chosen])
        n = size[context] + 1  # a symbol less than any byte ends each context
        at = np.r_[0, np.cumsum(n)]
        symbols = np.ones(at[-1], np.int16)
        inside = np.ones(at[-1], bool)
        inside[at[1:] - 1] = False
        symbols[inside] = texts[spans(begin[context], size[context])].astype(np.int16) + 2
        ends = np.cumsum(members[chosen])
        symbols[at[ends] - 1] = 0
        sorted_places = suffix_arrays(symbols, np.r_[0, at[ends]])
        # Only starts of whole windows stay; equal ones are neighbours.
        window_no = np.full(at[-1], -1)
        window_no[spans(at[:-1], count[context])] = spans(total[context], count[context])
        places = sorted_places[window_no[sorted_places] >= 0]
        owner = np.repeat(np.repeat(np.arange(len(chosen)), members[chosen]), n)[places]
        equal = owner[1:] == owner[:-1]
        for step in range(window):
            some = np.flatnonzero(equal)
            if not len(some):
                break
            equal[some] = symbols[places[some] + step] == symbols[places[some + 1] + step]
        first = np.flatnonzero(np.r_[True, ~equal])
        ids = window_no[places]
        low = np.minimum.reduceat(out[ids], first)
        out[ids] = np.repeat(low, np.diff(np.r_[first, len(ids)]))
    return out


def window_least(texts: np.ndarray, begin: np.ndarray, size: np.ndarray, least: np.ndarray, h: np.ndarray, window: int, gram: int, level: int = 0) -> np.ndarray:
    """As class_least, of distinct contexts of the anchors h (sorted), however many an anchor has."""
    count = size - window + 1
    at = np.r_[0, np.cumsum(count)]
    out = np.repeat(least, count)  # what an anchor with one context needs
    contexts = lengths(heads(h[1:] != h[:-1]), len(h))
    of_anchor, contexts = np.repeat(np.arange(len(contexts)), contexts), np.repeat(contexts, contexts)
    few, many = np.flatnonzero((contexts > 1) & (contexts <= CONTEXTS)), np.flatnonzero(contexts > CONTEXTS)
    if len(few):
        out[spans(at[few], count[few])] = class_least(texts, begin[few], size[few], least[few], of_anchor[few], window)
    if len(many):
        # Windows of one crowded anchor are cut up by their content: equal ones stay together.
        begin, size, least, count, anchor = begin[many], size[many], least[many], count[many], h[many]
        if level < LEVELS:
            body, bounds = texts[spans(begin, size)], np.r_[0, np.cumsum(size)]
            runs = _runs(body, bounds, window, gram, level + 2)
            names, first, length, owner = an.mix64(anchor[runs.doc]) ^ runs.h, runs.first, runs.last - runs.first + 1, runs.doc
        else:
            body, first, owner = texts, spans(begin, count), np.repeat(np.arange(len(many)), count)
            names, length = anchor[owner], np.ones(len(first), np.int64)
        digest = an.digests(body.tobytes(), first, first + length + window - 1)
        order, head, number = an.classes(names, digest)
        one, low = order[head], np.minimum.reduceat(least[owner][order], head)
        names = names[one]
        if level == LEVELS:  # distinct windows, by digest: neighbours share a suffix array
            names = names + (np.arange(len(one)) // CONTEXTS).astype(np.uint64)
            names = np.cumsum(np.r_[0, names[1:] != names[:-1]]).astype(np.uint64)
        found = window_least(body, first[one], length[one] + window - 1, low, names, window, gram, level + 1)
        # Runs and windows come in the order of contexts and starts, as `out` has them.
        place = np.r_[0, np.cumsum(length[one])[:-1]][number]
        out[spans(at[many], count)] = found[spans(place, length)]
    return out


def _judge(window: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        sent = an.unpacked(table)
        who = np.repeat(np.arange(len(sent)), [len(x["h"]) for x in sent])
        h, least, most, of, parts, size, body = (np.concatenate([x[c] for x in sent]) for c in ("h", "least", "most", "of", "parts", "size", "body"))
        del sent
        size = size.astype(np.int64)
        begin = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64)
        digest = an.digests(body.tobytes(), begin, begin + size)
        order, head, context = an.classes(h, digest)
        one = order[head]
        found = window_least(body, begin[one], size[one], np.minimum.reduceat(least[order], head), h[one], window, gram)
        count = size[one] - window + 1
        at = np.r_[0, np.cumsum(count)]
        told = np.flatnonzero(np.minimum.reduceat(found, at[:-1])[context] < most)  # some document of the sender loses bytes
        b, bucket, rows = table.column("b").to_pylist(), table.column("bucket")[0].as_py(), []
        cuts = np.searchsorted(who[told], np.arange(len(b) + 1))
        for i, (lo, hi) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)):
            mine = told[lo:hi]  # a sender's rows are sorted by h
            if hi > lo:
                c = context[mine]
                rows.append((bucket, b[i], an.pack(h=h[mine], digest=digest[mine, 0], of=of[mine], parts=parts[mine], count=count[c].astype(np.int32), least=found[spans(at[c], count[c])])))
        return an.parcels(rows)

    return run


def _told(raw: bytes, runs: an.Runs, right: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of windows, the row of `runs` that each belongs to, and the least document
    that has each, from what a batch was answered."""
    told = an.unpacked(right)
    h, digest, of, parts, count, least = (np.concatenate([x[c] for x in told]) for c in ("h", "digest", "of", "parts", "count", "least"))
    at = np.r_[0, np.cumsum(count)].astype(np.int64)
    whole = of == 0
    mine = np.flatnonzero(an.among(runs.h, np.unique(h[whole])))
    # A context is known by its anchor's name and half of its digest, 112 bits.
    row = an.places_of(runs.h[mine], an.digests(raw, runs.first[mine], runs.last[mine] + window)[:, 0], h[whole], digest[whole])
    mine, row = mine[row >= 0], np.flatnonzero(whole)[row[row >= 0]]
    out = [(spans(runs.first[mine], count[row]), np.repeat(mine, count[row]), least[spans(at[row], count[row])])]
    if not whole.all():
        crowded, first = np.unique(of[~whole], return_index=True)
        mine = np.flatnonzero(an.among(runs.h, crowded))
        begin, end = runs.first[mine], runs.last[mine] + window
        order, head, number = an.classes(runs.h[mine], an.digests(raw, begin, end))
        one = order[head]
        w = _Windows(raw, begin[one], (end - begin)[one], runs.h[mine][one], parts[~whole][first][np.searchsorted(crowded, runs.h[mine][one])], window)
        row = an.places_of(w.h, w.digest[:, 0], h[~whole], digest[~whole])
        limit = np.where(row >= 0, least[at[:-1][np.flatnonzero(~whole)[row]]], NULL_ID)
        n = (end - begin) - window + 1
        out.append((spans(begin, n), np.repeat(mine, n), limit[spans(w.at[:-1][number], n)]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _cut_out(window: int, gram: int, with_text: bool):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        data, bounds, keys = _laid_out(left)
        raw, gone = data.tobytes(), np.zeros(len(data), bool)
        if right.num_rows and len(data):
            runs = _runs(data, bounds, window, gram)
            starts, row, limits = _told(raw, runs, right, window)
            starts = starts[limits < keys[runs.doc[row]]]
            gone = an.covered(starts, starts + window, len(data))
        out = []
        for lo, hi in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            lost = gone[lo:hi]
            kept = data[lo:hi][~lost].tobytes() if lost.any() else raw[lo:hi]
            n_spans = int(np.diff(np.r_[0, lost.astype(np.int8)]).clip(0).sum()) if hi > lo else 0
            out.append((hi - lo, int(lost.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        return pa.table([left.column("key"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["key", *names])

    return run


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row a document: its key, n_bytes, n_removed, n_spans (long; maximal removed
    runs), kept_sha256, and the kept bytes (null unless with_text).

    Keys are whole numbers.  A null or empty text has no bytes; a text however long is
    read whole, by the one task that has its batch.  Rows of one key are no smaller than
    each other and so remove nothing from each other; a null key ranks after all others.
    Other columns aren't read, whatever their names; an empty table gives an empty one.
    """
    n = an.width(docs, text)
    batches = an.dealt(docs, key, text, n)
    told = an.grouped(an.grouped(batches, "b", _seeds(window, gram, n), an.PARCEL), "bucket", an.shared_names, an.PARCEL)
    sent = an.with_answers(batches, told, _send(window, gram, n), an.PARCEL)
    judged = an.grouped(sent, "bucket", _judge(window, gram), an.PARCEL)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return an.with_answers(batches, judged, _cut_out(window, gram, with_text), schema).withColumnRenamed("key", key)
