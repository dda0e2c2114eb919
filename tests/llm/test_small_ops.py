"""Operators that SQL can't express, against plain Python on the small tables."""

import base64
import collections
import hashlib
import json
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestrand.llm import mixing, quality_rules, queries, secrets, simhash, warc

SF = "/root/testdata/sf0.001"
WS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, Size string, key string, fp string"


def odd_docs(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, None, s, None, "x", None, "y") for i, t, s in zip(ids, texts, ["b", None, "a"] * len(texts))]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- 1: secrets


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def rsa_key():
    numbers = [b"\0", b"\x00" + b"\xc1" * 128, b"\x01\x00\x01", *[b"\x11" * 64] * 6]
    return der(0x30, b"".join(der(2, n) for n in numbers))


def test_structures_are_confirmed_and_decoys_are_not():
    b64 = base64.b64encode(rsa_key()).decode()
    text = f"é x {b64} y"
    assert list(secrets.confirmed(text)) == [(4, 4 + len(b64), "der")]
    lines = "\n".join(b64[i : i + 64] for i in range(0, len(b64), 64))
    assert [k for *_, k in secrets.confirmed(f"-----BEGIN RSA PRIVATE KEY-----\n{lines}\n-----END")] == ["der"]
    assert list(secrets.confirmed(f"k {rsa_key().hex()} z")) == [(2, 2 + 2 * len(rsa_key()), "der")]
    broken = bytearray(rsa_key())
    broken[5] += 1  # an inner length
    assert not list(secrets.confirmed(base64.b64encode(bytes(broken)).decode()))
    public = der(0x30, der(0x30, der(6, b"\x2a\x86\x48")) + der(3, b"\0" * 64))
    assert not list(secrets.confirmed(base64.b64encode(public).decode()))
    s = lambda x: len(x).to_bytes(4, "big") + x
    ssh = secrets.SSH_MAGIC + s(b"none") + s(b"none") + s(b"") + b"\0\0\0\1" + s(s(b"ssh-ed25519") + s(b"k" * 32)) + s(b"p" * 64)
    assert [k for *_, k in secrets.confirmed(base64.b64encode(ssh).decode())] == ["ssh"]
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': '1'})}.c2ln"
    assert list(secrets.confirmed(f"a {token} b")) == [(2, 2 + len(token), "token")]
    assert not list(secrets.confirmed(f"a {part({'typ': 'JWT'})}.{part({'sub': '1'})}.c2ln b"))
    assert not list(secrets.confirmed("thelongestwordthatanyonehaseverseeninthislanguage " * 50))


def plain_base(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_secret_query_has_the_plain_spans(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    counted = collections.Counter()
    for r in queries.op1_secrets(spark, "/root/testdata/sf0.01").collect():
        same_secrets(r, texts[r.doc_id])
        counted.update(s.split(":")[0] for s in r.spans.split(",") if s)
    assert counted


def same_secrets(row, text):
    base = plain_base(text)
    assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    kinds = [s.split(":")[0] for s in base.split(",")]
    assert (row.n_assign, row.n_access, row.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
    spans = row.spans.split(",") if row.spans else []
    places = [(int(s.split(":")[1]), secrets.KINDS.index(s.split(":")[0])) for s in spans]
    assert places == sorted(places) and [s for s in spans if s.split(":")[0] in secrets.KINDS[:3]] == [s for s in base.split(",") if s]
    more = [s for s in spans if s.split(":")[0] not in secrets.KINDS[:3]]
    assert len(more) == row.n_confirmed and set(more) == {f"{k}:{a}:{b}" for a, b, k in secrets.confirmed(text)}


def test_secret_scan_of_odd_rows(spark):
    texts = [None, "", "password = token: abcdefg", "AKIAAKIA" + "B" * 13, "ſecret=abcdefg toKen='abcdef'", "a" * 200_000, "x=" * 50_000, "", "same", "same"]
    df = odd_docs(spark, texts, [0, 1, 2, 3, 4, 5, 6, None, 9, 9])
    got = secrets.scan(df).collect()
    assert len(got) == len(texts)
    for r, t in zip(got, texts):
        same_secrets(r, t or "")
    assert secrets.scan(df.limit(0)).collect() == []
    assert [r.text for r in secrets.redact_docs(odd_docs(spark, [None, "", "token=abcdef!", "token=abcdef!"])).collect()] == [None, "", "[SECRET]!", "[SECRET]!"]
    both = spark.createDataFrame([("token=abcdef!", "token=ghijkl!", 1)], "text string, body string, key long")
    assert [tuple(r) for r in secrets.redact_docs(both, "body").collect()] == [("token=abcdef!", "[SECRET]!", 1)]


# -- 4: mixing


def test_mix_of_odd_rows(spark):
    texts = [None, "", "a b c", "a b c", "d e", "f " * 5000, "g h", "i"]
    df = odd_docs(spark, texts, [0, 1, 2, 2, None, 5, 6, 7])
    got = mixing.mix(df, per_range=2).collect()
    assert len(got) == len(texts) and sorted(r.size for r in got) == [0, 0, 1, 2, 2, 3, 3, 5000]
    by = collections.defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source].append(r)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) < 1.001
        assert rows[0].source_size == sum(r.size for r in rows)
    assert sum(rows[0].target for rows in by.values()) == pytest.approx(sum(r.size for r in got))
    assert mixing.mix(df.limit(0)).collect() == []
    again = mixing.mix(df.repartition(3), per_range=1000).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.take(df, mixing.mix(df)).count() >= 1


def test_mix_of_a_hot_id_and_many_sources(spark):
    rows = [(None if k % 3 else k, f"{'w ' * (k % 7)}{k}", f"host{k % 40}" if k % 2 else "hot", k) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row long")
    want = sorted(map(tuple, mixing.mix(df, per_range=10_000, row="row").collect()), key=str)
    few = mixing.mix(df, per_range=15, row="row")
    got = few.collect()
    # Of rows without an id, which order is theirs is told by size and text alone.
    assert sorted(map(tuple, got), key=str) == want and len({r.row for r in got}) == 400
    sums = collections.Counter()
    for r in got:
        sums[r.source] += r.taken
    assert all(abs(sums[r.source] - r.target) < 1.001 for r in got)
    back = mixing.take(df, few, "row", ("taken",)).collect()
    assert {r.row: r.taken for r in back} == {r.row: r.taken for r in got if r.taken}
    assert all(r.epochs * len(r.text.split()) + r.rest_words == r.taken for r in back)


def test_prefix_sums_over_ranges(spark):
    rng = np.random.default_rng(9)
    values = rng.integers(0, 5, 300).tolist()
    df = spark.createDataFrame(list(enumerate(values)), "_part long, n long")
    got = {r._part: r.before for r in mixing.prefix_sums(df, [F.col("n"), F.col("_part").desc()], {"before": "n"}, 20).collect()}
    order = sorted(range(300), key=lambda i: (values[i], -i))
    assert got == {i: sum(values[j] for j in order[:k]) for k, i in enumerate(order)}


def test_targets_stop_at_the_cap_and_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 1000, 1), (None, 0, 1)], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and got[None] == 0
    assert got["b"] == pytest.approx(1980 * 2 / 3) and got["c"] == pytest.approx(1980 / 3)


# -- 8: WARC


def test_warc_round_trip_of_odd_rows(spark):
    html = [None, "", "é" * 100_000, "x", "x", "x", "", "long " * 300_000, "WARC/1.1\r\n\r\nx"]
    ids = [5, 3, 2, 9, 4, None, 3, 8, 7]
    df = spark.createDataFrame([(i, None, h, "z") for i, h in zip(ids, html)], "page_id long, url string, html string, Key string")
    got = warc.round_trip(spark, df).collect()
    assert len(got) == len(html)
    want = collections.Counter()
    for i, h in zip(ids, html):
        same = [j for j, g in zip(ids, html) if (g or "") == (h or "") and j is not None]
        data = (h or "").encode()
        least = min(same) if same and min(same) != i else None
        want[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if least is None else "revisit", least)] += 1
    assert collections.Counter(map(tuple, got)) == want
    assert warc.round_trip(spark, df.limit(0)).collect() == []


def test_warc_copies_by_a_broadcast_table_and_without(spark, monkeypatch):
    df = spark.createDataFrame([(7, None, "p"), (3, None, "p"), (3, None, "p"), (None, None, "p"), (4, None, "q"), (4, None, "r")], "page_id long, url string, html string")
    want = [(None, "revisit", 3), (3, "response", None), (3, "response", None), (4, "response", None), (4, "response", None), (7, "revisit", 3)]
    for hot in (100_000, 2):
        monkeypatch.setattr(warc, "HOT", hot)
        got = [(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(spark, df).collect()]
        assert sorted(got, key=lambda r: (r[0] or 0, r[1])) == want


def test_no_whole_payload_is_exchanged(spark):
    rows = spark.createDataFrame([(1, "x" * 1000)], "a long, p string").select("a", F.encode("p", "UTF-8").alias("p"))
    plan = warc.chunk_rows(rows, "p", 64)._jdf.queryExecution().executedPlan().toString()
    assert "Generate posexplode" in plan and "Exchange" not in plan
    generate = next(x for x in plan.split("\n") if "Generate" in x)
    assert "[a#" in generate and ", p#" not in generate.split("posexplode", 1)[1].split("],", 1)[1]


def test_warc_payloads_come_back_in_chunks(spark, tmp_path):
    html = ["a" * 1000, "", "\r\n\r\nb\n" * 77]
    df = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    root = f"file://{tmp_path}/w"
    rows = warc.read(warc.write(df, root, chunk_bytes=64), root, chunk_bytes=64).collect()
    assert max(len(r.data) for r in rows) == 64
    for i, h in enumerate(html):
        own = sorted((r for r in rows if r.key == str(i)), key=lambda r: r.chunk_no)
        assert b"".join(r.data for r in own).decode() == h and [r.last for r in own] == [False] * (len(own) - 1) + [True]
        assert own[-1].payload_digest == own[-1].digest_so_far == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()


# -- 9: SimHash


def plain_fingerprint(text, size=4):
    words = WS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=4):
    """rows: (key, fingerprint). The least key that each reaches."""
    fps = np.array([f for _, f in rows], np.uint64)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            root[find(int(j))] = find(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), k) if x is not None), default=None)
    return [(k, f"{f:016x}", least[find(i)]) for i, (k, f) in enumerate(rows)]


def test_simhash_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs])
    got = queries.op9_simhash(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert len({c for *_, c in want}) < len(want)


def test_simhash_of_odd_rows(spark):
    texts = [None, "", " \n", "One two", "one TWO", "Éa b c d e", "a " * 100_000, "one two three four"]
    ids = [4, 3, None, 8, 7, 6, 5, 7]
    got = simhash.near_duplicates(odd_docs(spark, texts, ids)).collect()
    want = plain_components([(i, plain_fingerprint(t or "")) for i, t in zip(ids, texts)])
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert simhash.near_duplicates(odd_docs(spark, texts, ids).limit(0)).collect() == []


def test_gray_index_joins_what_all_pairs_join():
    rng = np.random.default_rng(1)
    for n, flips in ((1, 2), (300, 2), (3000, 3), (3000, 6)):
        centre = rng.integers(0, 1 << 63, 7, dtype=np.uint64)
        values = centre[rng.integers(0, 7, n)]
        for _ in range(flips):
            values = values ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
        values = np.unique(values)
        groups = (values % np.uint64(3)).astype(np.int64)
        a, b = simhash.group_links(groups, values, 4)
        at = {int(v): i for i, v in enumerate(values)}
        mine = simhash.merged(np.arange(len(values)), np.array([at[int(x)] for x in a], int), np.array([at[int(x)] for x in b], int))
        near = (np.bitwise_count(values[:, None] ^ values[None]) <= 4) & (groups[:, None] == groups[None])
        theirs = simhash.merged(np.arange(len(values)), *np.nonzero(near))
        assert (mine == theirs).all()


def test_crowded_keys_are_filed_anew_and_lose_no_link(spark):
    rng = np.random.default_rng(4)
    values = np.full(1500, 0x0123456789ABCDEF, np.uint64)  # one family: crowded under every key
    for _ in range(7):
        values = values ^ (np.uint64(1) << rng.integers(0, 64, len(values), dtype=np.uint64))
    values = np.unique(np.r_[values, rng.integers(0, 1 << 63, 500, dtype=np.uint64)])
    near = np.bitwise_count(values[:, None] ^ values[None]) <= 4
    want = simhash.merged(np.arange(len(values)), *np.nonzero(near))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long").repartition(3)
    at = {int(v): i for i, v in enumerate(values.view(np.int64))}
    for crowd in (5, 100, 10_000):
        pairs = simhash.links(df, 4, crowd).collect()
        got = simhash.merged(np.arange(len(values)), np.array([at[r.a] for r in pairs], int), np.array([at[r.b] for r in pairs], int))
        assert (got == want).all()
    assert len(set(want.tolist())) > 500
    assert not simhash.can_crowd(-1, 1) and simhash.can_crowd((1 << 60) - 1, 15) and not simhash.can_crowd((1 << 60) - 1, 16)


def test_components_of_long_chains(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def join_rows(spark, work):
    """The rows that the joins of some work make."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    work()
    bus.waitUntilEmpty()
    executions, made = store.executionsList(), 0
    assert 0 < store.executionsCount() - before < 500  # of which the store keeps 1,000
    for k in range(executions.size() - (store.executionsCount() - before), executions.size()):
        run = executions.apply(k).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Join" in node.name() and metric.name() == "number of output rows":
                    made += int(values.get(metric.accumulatorId()).getOrElse(None).replace(",", "")) if values.contains(metric.accumulatorId()) else 0
    return made


def test_components_join_the_edges_of_dense_groups_once(spark):
    rng, at = random.Random(4), list(range(3 * 40))
    rng.shuffle(at)
    groups = [at[k : k + 40] for k in range(0, 120, 40)]
    pairs = [(a, b) for group in groups for a in group for b in group if a < b]
    pairs += [(groups[0][0], groups[1][0]), (groups[1][1], groups[2][1])]
    got = {}
    made = join_rows(spark, lambda: got.update({r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}))
    assert got == dict.fromkeys(at, 0)
    assert made < 3 * len(pairs)  # each edge for its two ends, and not in each round again


# -- 10: quality rules


def plain_counts(text):
    words = WS.findall(text)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_query_against_plain_counts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    words = {i: WS.findall(t) for i, t in texts.items()}
    one = {w for ws in words.values() for w in ws}
    two = {p for ws in words.values() for p in zip(ws, ws[1:])}
    hashed = spark.createDataFrame([(w,) for w in one], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    paired = spark.createDataFrame(list(two), "a string, b string").select("a", "b", F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h")).collect()
    bucket = {r.w: r.h % 65536 for r in hashed} | {(r.a, r.b): r.h % 65536 for r in paired}
    grams = {i: [bucket[g] for g in [*ws, *zip(ws, ws[1:])]] for i, ws in words.items()}
    raw, target = np.zeros(65536), np.zeros(65536)
    for i, own in grams.items():
        np.add.at(raw, own, 1)
        if i in good:
            np.add.at(target, own, 1)
    model = np.log((target + 0.5) / (target.sum() + 32768)) - np.log((raw + 0.5) / (raw.sum() + 32768))
    got = {r.doc_id: r for r in queries.op10_quality_rules(spark, SF).collect()}
    assert got.keys() == texts.keys()
    threshold = 2 * min(0, np.quantile([got[i].llr for i in good], 0.002))
    for i, t in texts.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.llr == pytest.approx(model[grams[i]].mean())
        assert r.kept == (not r.base_failed and r.llr >= threshold)


def test_quality_rules_of_odd_rows(spark):
    texts = [None, "", "\n\n \t", "a b c d e f g h i a b c d e f g h", "x " * 50_000, "l\nl\n l\nl", "é€😀 ok", "😀 " * 30, "a", "a"]
    df = odd_docs(spark, texts, [0, 1, 2, 3, 4, 5, 6, None, 8, 8])
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, 0), (6, None, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    ids = quality_rules.trusted_ids(labels)
    model = quality_rules.fit(df, ids)
    got = quality_rules.assess(df, model, threshold=quality_rules.calibrate(df, ids, model)).collect()
    for r, t in zip(got, texts):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(t or "")
    empty = quality_rules.fit(df, ids.limit(0))
    assert set(empty) == {0.0} and quality_rules.calibrate(df, ids.limit(0), empty) == 0
    assert quality_rules.assess(df.limit(0), quality_rules.fit(df.limit(0), ids)).collect() == []
    single = quality_rules.fit(df, ids, orders=(1,))
    assert len(quality_rules.assess(df, single, orders=(1,)).collect()) == len(texts)
    shuffled = spark.createDataFrame([("p q r s t",), ("t s r q p",)], "text string")
    known = quality_rules.fit(spark.createDataFrame([(1, "p q r s t"), (2, "t s r q p")], "doc_id long, text string"), spark.createDataFrame([(1,)], "doc_id long"))
    right, wrong = (r.llr for r in quality_rules.assess(shuffled, known).collect())
    assert right > wrong  # word order counts


def test_quality_plans_do_not_spell_out_the_model(spark):
    docs = odd_docs(spark, ["a b c"], [1])
    model = [math.log(k + 1) for k in range(1 << 16)]
    for orders in ((1,), (1, 2)):
        for columns in (["llr"], ["*"]):
            plan = quality_rules.assess(docs, model, orders=orders).select(*columns)._jdf.queryExecution().toString()
            optimized = plan[plan.index("== Optimized") :]
            assert len(plan) < 100_000 and "_model" not in optimized  # neither a literal nor a column of the rows
    got = quality_rules.assess(docs, model, orders=(1,)).collect()[0].llr
    hashed = [r.h for r in spark.createDataFrame([("a",), ("b",), ("c",)], "w string").select(F.xxhash64("w").alias("h")).collect()]
    assert got == pytest.approx(np.mean([model[h % (1 << 16)] for h in hashed]))


def test_every_trusted_row_counts(spark):
    n = 5_500  # the model came from 5,000 of them before
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"))
    trusted = quality_rules.trusted_ids(docs.select("doc_id", F.lit(1).alias("quality")))
    assert set(quality_rules.fit(docs, trusted, orders=(1,))) == {0.0}
    dealt, sent = (quality_rules._marked(docs.withColumnRenamed("doc_id", "_id"), trusted.union(trusted), "doc_id", "left", k) for k in (10, n))
    assert dealt.count() == sent.count() == dealt.filter("_trusted = 1").count() == n
    # Ratios fall from document to document, so the threshold must see the last ones.
    lines = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("a "), F.array_join(F.array_repeat(F.lit("b"), F.col("id").cast("int") % 100), " ")).alias("text"))
    hashed = [r.h % (1 << 16) for r in spark.createDataFrame([("a",), ("b",)], "w string").select(F.xxhash64("w").alias("h")).collect()]
    model = [0.0] * (1 << 16)
    model[hashed[0]], model[hashed[1]] = 0.0, -1.0
    ratios = [-(i % 100) / (i % 100 + 1) for i in range(n)]
    assert quality_rules.calibrate(lines, trusted, model, orders=(1,)) == pytest.approx(2 * np.quantile(ratios, 0.002))


def test_quantiles_are_exact(spark):
    for values in ([3.0], [1.0, 2.0], [0.0] * 50, [k % 7919 / 7 for k in range(20_000)], [-1.0] * 7 + [0.0] * 12_000):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for q in (0.0, 0.002, 0.5, 1.0):
            assert quality_rules._quantile(df, "v", q) == pytest.approx(np.quantile(values, q))
    assert quality_rules._quantile(df.limit(0), "v", 0.5) is None
