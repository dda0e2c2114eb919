"""Operators over shared anchors, the classifier and decontamination."""

import collections
import hashlib
import re

import numpy as np
import pytest

from lodestrand.llm import anchors, decontaminate, quality_cnn, queries, substring_dedup, suffix_dedup
from tests.llm.test_small_ops import SF, odd_docs

WS = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.01"


def plain_words(rows, window=35):
    words = [WS.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return collections.Counter(out)


def plain_bytes(rows, window=50):
    first = {}
    data = [((1 << 63) - 1 if k is None else k, (t or "").encode()) for k, t in rows]
    for k, b in data:
        for i in range(len(b) - window + 1):
            s = b[i : i + window]
            first[s] = min(k, first.get(s, k))
    out = []
    for (key, _), (k, b) in zip(rows, data):
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < k:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((key, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def test_substring_dedup_query_against_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op5_substring_dedup(spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == plain_words(rows)


def test_suffix_dedup_query_against_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op3_suffix_dedup(spark, SF).collect()
    assert collections.Counter(map(tuple, got)) == plain_bytes(rows)


def odd_texts():
    rng = np.random.default_rng(3)
    words = lambda n, v: " ".join(f"w{x}" for x in rng.integers(0, v, n))
    passage = words(60, 1000)
    texts = [None, "", "x", f"{words(50, 900)} {passage} {words(9, 9)}", f"{passage}\n{words(40, 900)}", "same " * 100, "é" * 80, "é" * 80, words(600, 2), words(600, 2), passage, passage]
    return texts, [4, 3, 2, 9, 1, 8, 7, 6, None, 0, 10, 10]


def test_dedup_of_odd_rows(spark, monkeypatch):
    texts, ids = odd_texts()
    df = odd_docs(spark, texts, ids)
    rows = list(zip(ids, texts))
    got = substring_dedup.dedup(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == plain_words(rows)
    got = suffix_dedup.dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == plain_bytes(rows)
    assert substring_dedup.dedup(df.limit(0)).collect() == [] and suffix_dedup.dedup(df.limit(0)).collect() == []
    kept = {r.doc_id: r.kept for r in suffix_dedup.dedup(df, with_text=True).collect()}
    assert kept[6].decode() == "é" * 80 and kept[7] == b""


def test_runs_are_the_same_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    lengths = rng.integers(0, 90, 200)
    bounds = np.r_[0, np.cumsum(lengths)]
    units = anchors.mix64(rng.integers(0, 3, bounds[-1]).astype(np.uint64) + np.uint64(1))
    windows = [(d, i) for d, (lo, hi) in enumerate(zip(bounds, bounds[1:])) for i in range(lo, hi - 49)]
    found = []
    for piece in (1 << 18, 64):
        monkeypatch.setattr(anchors, "PIECE", piece)
        runs = anchors.Runs(units, bounds, 50, 20)
        count = runs.last - runs.first + 1
        assert list(zip(np.repeat(runs.doc, count).tolist(), runs.starts().tolist())) == windows
        found.append(np.repeat(runs.h, count))
    assert (found[0] == found[1]).all()


def test_suffix_arrays_are_sorted():
    rng = np.random.default_rng(0)
    for _ in range(60):
        texts = [[*rng.integers(1, 1 + rng.integers(1, 4), rng.integers(0, 40)), 0] for _ in range(rng.integers(1, 6))]
        symbols, bounds = np.array([x for t in texts for x in t], np.int16), np.r_[0, np.cumsum([len(t) for t in texts])]
        out = suffix_dedup.suffix_arrays(symbols, bounds)
        for lo, hi in zip(bounds, bounds[1:]):
            assert out[lo:hi].tolist() == sorted(range(lo, hi), key=lambda i: list(symbols[i:hi]))


def test_windows_learn_their_least_document_however_many_contexts(monkeypatch):
    rng = np.random.default_rng(2)
    n = 2600
    size, h = rng.integers(10, 25, n), np.sort(np.r_[np.full(2000, 5), rng.integers(6, 90, n - 2000)]).astype(np.uint64)
    texts, begin, least = rng.integers(0, 2, size.sum()).astype(np.uint8), np.r_[0, np.cumsum(size)[:-1]], rng.permutation(n)
    first = {}
    windows = [(int(h[c]), texts[begin[c] + i : begin[c] + i + 8].tobytes(), int(least[c])) for c in range(n) for i in range(size[c] - 7)]
    for a, w, k in windows:
        first[a, w] = min(k, first.get((a, w), n))
    want = [first[a, w] for a, w, _ in windows]
    for levels in (0, 2):
        monkeypatch.setattr(suffix_dedup, "LEVELS", levels)
        assert suffix_dedup.window_least(texts, begin, size, least, h, 8, 4).tolist() == want
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", n)  # one suffix array for each anchor
    assert suffix_dedup.window_least(texts, begin, size, least, h, 8, 4).tolist() == want


def plain_stretches(contexts, window, gram):
    out = []
    for c, (words, before, seed) in enumerate(contexts):
        best = (-1, -1)
        for d, (other, at, its) in enumerate(contexts):
            if c != d and seed == its:
                for back in range(min(before, at) + 1):
                    if words[before - back : before] != other[at - back : at]:
                        break
                    on = 0
                    while before + gram + on < len(words) and at + gram + on < len(other) and words[before + gram + on] == other[at + gram + on]:
                        on += 1
                    if back + gram + on >= window:
                        best = max(best[0], back), max(best[1], on)
        out.append(best)
    return out


def test_seeds_extend_to_what_pairs_extend_to():
    rng = np.random.default_rng(6)
    for _ in range(30):
        contexts = []
        for _ in range(60):
            before, after, seed = int(rng.integers(0, 6)), int(rng.integers(0, 6)), int(rng.integers(0, 4))
            contexts.append(([*rng.integers(1, 3, before).tolist(), 90 + seed, 80 + seed, *rng.integers(1, 3, after).tolist()], before, seed))
        size = np.array([len(w) for w, *_ in contexts])
        units = np.array([x for w, *_ in contexts for x in w], np.uint64)
        got = substring_dedup.extended(units, np.r_[0, np.cumsum(size)[:-1]], size, np.array([b for _, b, _ in contexts]), np.array([s for *_, s in contexts]), 7, 2)
        assert list(zip(*(x.tolist() for x in got))) == plain_stretches(contexts, 7, 2)


def crowded_docs(spark):
    """A short phrase in over a thousand texts, with others around it, and copies of some."""
    rng = np.random.default_rng(8)
    words = lambda n, v: " ".join(f"w{x}" for x in rng.integers(0, v, n))
    phrase, passage = words(14, 10**6), words(45, 10**6)
    texts = [f"{words(int(rng.integers(0, 25)), 3)} {phrase} {words(int(rng.integers(0, 25)), 3)}" for _ in range(1100)]
    texts += [f"{words(4, 10**6)} {passage} {words(4, 10**6)}" for _ in range(60)] + texts[:20]
    ids = rng.permutation(len(texts)).tolist()
    return spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), list(zip(ids, texts))


@pytest.mark.parametrize(("crowd", "least"), [(1 << 16, 8000), (40, 8000), (40, 1 << 22)])
def test_dedup_of_an_anchor_with_a_thousand_contexts(spark, monkeypatch, crowd, least):
    monkeypatch.setattr(anchors, "LEAST_BYTES", least)
    # Workers import the module anew, so the function that they run takes the value along.
    monkeypatch.setattr(anchors, "shared_names", lambda table: _names(table, crowd))
    df, rows = crowded_docs(spark)
    assert (anchors.width(df, "text") > 10) == (least == 8000)
    got = suffix_dedup.dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == plain_bytes(rows)
    got = substring_dedup.dedup(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == plain_words(rows)


def _names(table, crowd):
    from lodestrand.llm import anchors as at

    was, at.CROWD = at.CROWD, crowd
    try:
        return at.shared_names(table)
    finally:
        at.CROWD = was


def test_parcels_grow_with_the_text_and_not_faster(spark, monkeypatch):
    df = spark.createDataFrame([("x" * 100_000,)], "text string")
    monkeypatch.setattr(anchors, "LEAST_BYTES", 1000)
    n = [anchors.width(df.join(spark.range(k)), "text") for k in (1, 4, 16)]
    assert [x * x * anchors.PARCEL_BYTES <= 1.3 * k * 100_000 for x, k in zip(n, (1, 4, 16))] == [True] * 3
    assert n[0] < n[1] < n[2]
    names = anchors.Runs(anchors.mix64(np.arange(1, 200_000, dtype=np.uint64)), np.array([0, 199_999]), 50, 20).h
    share = np.bincount(anchors.buckets_of(names, 50), minlength=50)
    assert share.max() < 1.3 * share.mean()


def test_decontamination_against_exact_passages(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet").collect(), spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in queries.op6_decontamination(spark, SF).collect()}
    exact = {(d.doc_id, i.item_id) for d in docs for i in items if " ".join(i.text.split()) in " ".join(d.text.split())}
    assert exact and exact <= set(got) and all(got[k] == 1 for k in exact)
    shingles = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    words = {d.doc_id: d.text.lower().split() for d in docs}
    for (d, i), s in got.items():
        item = next(x.text for x in items if x.item_id == i).lower().split()
        windows = [words[d][k : k + len(item)] for k in range(max(1, len(words[d]) - len(item) + 1))]
        best = max(sum((shingles(w) & shingles(item)).values()) / sum((shingles(w) | shingles(item)).values()) for w in windows)
        assert s >= 0.8 and abs(best - s) < 1e-9


def test_decontamination_of_odd_rows(spark, monkeypatch):
    item = " ".join(f"q{i}" for i in range(30))
    texts = [None, "", item.upper(), " ".join(item.split()[:27]), f"a b {item} c", " ".join(item.split()[10:]), "x " * 50_000, f"a b {item} c"]
    df = odd_docs(spark, texts, [0, 1, 2, 3, None, 5, 6, None])
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (None, "zz yy", "x")], "item_id long, text string, doc_id string")
    want = [(2, 1), (3, 1), (None, 1), (None, 1)]
    key = lambda p: (str(p[0]), p[1])
    assert sorted([(r.doc_id, r.item_id) for r in decontaminate.find(df, bench).collect()], key=key) == sorted(want, key=key)
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 1)
    assert sorted([(r.doc_id, r.item_id) for r in decontaminate.find(df, bench).collect()], key=key) == sorted(want, key=key)
    assert [r.doc_id for r in decontaminate.clean(df, bench).collect()] == [0, 1, 5, 6]
    assert decontaminate.find(df.limit(0), bench).collect() == [] and decontaminate.find(df, bench.limit(0)).collect() == []


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    index = decontaminate.BenchmarkIndex([(i, " ".join(map(str, rng.integers(0, 99, 20)))) for i in range(50)])
    prints = index.prints[rng.integers(0, 50, 400)]
    for _ in range(14):
        prints = prints ^ np.where(rng.random(400) < 0.9, np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64), np.uint64(0))
    got = set(zip(*map(np.ndarray.tolist, index.lookup(prints))))
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(np.bitwise_count(prints[:, None] ^ index.prints[None]) <= index.radius))))


def test_classifier_on_held_out_rows(spark):
    scored = queries.op2_quality_cnn(spark, SMALL)
    rows = scored.join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert scored.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_classifier_of_odd_rows(spark):
    texts = [None, "", "a", "é" * 100_000, "b", "b"]
    df = odd_docs(spark, texts, [0, 1, 2, None, 4, 4])
    labels = spark.createDataFrame([(0, 1), (1, None), (2, 0), (None, 1), (4, 5)], "doc_id long, quality int")
    net = quality_cnn.fit(df, labels)
    rows = quality_cnn.score(df, net).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_cnn.score(df, quality_cnn.fit(df, labels.limit(0))).collect()} == {0.5}
    assert quality_cnn.score(df.limit(0), net).collect() == []
    a, b = quality_cnn.scores(net, ["x" * 5000, "yz"] * 40), quality_cnn.scores(net, ["yz"])
    assert abs(a[1] - b[0]) < 1e-6
    assert df.select(quality_cnn.held_out()).collect()[3][0] is False


def plain_logit(net, text):
    """The network by loops over single numbers."""
    data = [*text.encode()]
    n = 1
    while (n - 1) * quality_cnn.HOP + quality_cnn.CHUNK < len(data):
        n += 1
    hidden = []
    for k in range(n):
        chunk = data[k * quality_cnn.HOP : k * quality_cnn.HOP + quality_cnn.CHUNK]
        chunk += [quality_cnn.PAD] * (quality_cnn.CHUNK - len(chunk))
        top = []
        for f in range(quality_cnn.FILTERS):
            values = []
            for at in range(0, quality_cnn.CHUNK - quality_cnn.WIDTH + 1, quality_cnn.STRIDE):
                values.append(sum(float(net["embed"][chunk[at + i]][e]) * float(net["filters"][i * quality_cnn.EMBED + e][f]) for i in range(quality_cnn.WIDTH) for e in range(quality_cnn.EMBED)))
            top.append(max(0.0, max(values) + float(net["shift"][f])))
        hidden.append([max(0.0, sum(top[f] * float(net["mid"][f][h]) for f in range(quality_cnn.FILTERS)) + float(net["mid_shift"][h])) for h in range(quality_cnn.HIDDEN)])
    both = [sum(c) / n for c in zip(*hidden)] + [max(c) for c in zip(*hidden)]
    return sum(x * float(w) for x, w in zip(both, net["out"])) + float(net["out_shift"][0])


def test_network_against_plain_loops_and_its_slopes():
    net = quality_cnn.initial(3)
    rng = np.random.default_rng(1)
    net["shift"][:], net["mid_shift"][:] = rng.normal(0, 0.1, 32), rng.normal(0, 0.1, 16)
    texts = ["", "short é", "".join(map(chr, rng.integers(32, 127, 700)))]
    want = [plain_logit(net, t) for t in texts]
    assert np.allclose(quality_cnn.scores(net, texts), 1 / (1 + np.exp(-np.array(want))), atol=1e-5)
    docs, y = [quality_cnn.chunks_of(t) for t in texts], np.array([1, 0, 1], np.float32)
    chunks, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
    exact = {k: v.astype(np.float64) for k, v in net.items()}

    def loss(parts):
        heads = np.r_[0, np.cumsum(sizes)[:-1]]
        logit = quality_cnn._combined(parts, quality_cnn.pooled(parts, chunks)[0], heads)[0]
        return float(np.mean(np.log1p(np.exp(logit)) - y * logit))

    grad = quality_cnn.gradients(exact, chunks, sizes, y)
    for name, values in exact.items():
        if name == "embed":
            places = [(int(b), int(e)) for b, e in zip(chunks[2][:6], rng.integers(0, 8, 6))]
        else:
            places = [tuple(int(rng.integers(0, n)) for n in values.shape) for _ in range(6)]
        for place in places:
            was, both = values[place], []
            for step in (1e-6, -1e-6):
                values[place] = was + step
                both.append(loss(exact))
            values[place] = was
            assert abs((both[0] - both[1]) / 2e-6 - grad[name][place]) < 1e-5


def test_classifier_learns_from_whole_texts_and_bounded_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_cnn, "train", lambda texts, labels: seen.append((texts, labels)))
    long = "begin " + "x" * 50_000 + " end"
    df = odd_docs(spark, [long, "b", "b", "c", "d", None], [0, 2, 2, 2, 3, 5])
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    held = {r.doc_id for r in df.filter(quality_cnn.held_out()).collect()}
    quality_cnn.fit(df, labels)
    want = {(t or "", i % 2) for t, i in zip([long, "b", "c", "d", None], [0, 2, 2, 3, 5]) if i not in held}
    assert set(zip(*seen[0])) == want and len(seen[0][0]) == len(want)
    quality_cnn.fit(df, labels, sample=2)
    assert len(seen[1][0]) <= 2
    quality_cnn.fit(df, labels, sample_bytes=100)
    assert long not in seen[2][0] and set(zip(*seen[2])) == want - {(long, 0)}


def test_sql_of_the_dedup_queries_against_plain():
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    assert collections.Counter(con.execute(queries.OP3_SQL).fetchall()) == plain_bytes(rows)
    words = con.execute(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({queries.OP5_SQL})").fetchall()
    assert collections.Counter(words) == plain_words(rows)
