"""The pipeline's near duplicates against exact similarities of all pairs."""

import random

import numpy as np

import corpus_pipeline as cp
from lodestrand.llm import similar, simhash
from tests.llm.test_small_ops import SF, WS, odd_docs, plain_fingerprint


def shingles(text):
    words = WS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_kept(texts):
    """The least id of each group that chains of pairs of 0.8 or more join, and those pairs of different sets."""
    sets, root, pairs = {i: shingles(t or "") for i, t in texts.items()}, {i: i for i in texts}, []

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(texts):
        for j in sorted(texts):
            a, b = sets[i], sets[j]
            if i < j and min(len(a), len(b)) >= 0.79 * max(len(a), len(b)) and alike(a, b) >= 0.8:
                pairs += [(i, j)] * (a != b)
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i for i in texts if find(i) == i}, pairs


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.random()}"
    return words


def test_pairs_that_are_not_identical_are_found(spark):
    rng = random.Random(5)
    texts = []
    for k in range(150):  # 60 to 400 words, up to a similarity just above and below 0.8
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 400))]
        texts += [" ".join(words), " ".join(edited(rng, words, rng.randrange(1, max(2, len(words) // 25))))]
    texts = dict(enumerate(texts))
    want, pairs = plain_kept(texts)
    assert len(pairs) > 50 and len(want) > 150
    got = {r.doc_id for r in cp.near_duplicates(spark, odd_docs(spark, list(texts.values())), SF).collect()}
    assert got == want


def test_small_table_has_the_exact_groups(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, pairs = plain_kept({r.doc_id: r.text for r in docs.collect()})
    assert len(pairs) == 2  # 11 and 17 bits apart
    assert {r.doc_id for r in cp.near_duplicates(spark, docs, SF).collect()} == want


def test_near_fingerprints_below_the_similarity_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id IN (155, 192)")
    texts = {r.doc_id: r.text for r in docs.collect()}
    a, b = (plain_fingerprint(t, cp.SHINGLE) for t in texts.values())
    assert (a ^ b).bit_count() <= 6 and alike(*map(shingles, texts.values())) < 0.8
    assert {r.doc_id for r in cp.near_duplicates(spark, docs, SF).collect()} == {155, 192}


def test_families_join_only_by_pairs_of_the_similarity():
    rng, sets = np.random.default_rng(3), []
    for centre in range(4):  # chains whose ends are far apart, and members just below the bound
        pool = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
        sets += [pool[k : k + 60] for k in range(0, 300, 5 + centre)]
    got_order, got = similar.verified_labels(np.array([similar.set_print(s) for s in sets], np.uint64), sets, 0.8, 64)
    mine = simhash.merged(np.arange(len(sets)), got_order, got_order[got])
    near = np.array([[alike(frozenset(a.tolist()), frozenset(b.tolist())) >= 0.8 for b in sets] for a in sets])
    assert (mine == simhash.merged(np.arange(len(sets)), *np.nonzero(near))).all()
    assert len(set(mine.tolist())) > 4


def test_rows_of_one_id_and_rows_without_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    df = odd_docs(spark, [a, b, a, c, c + " end", c, a], [5, 5, 7, None, None, 9, None])
    got = sorted((str(r.doc_id), r.text) for r in cp.near_duplicates(spark, df, SF).collect())
    assert [g for g in got if g[0] != "None"] == [("5", a), ("5", b), ("9", c)]
    alone = [t for i, t in got if i == "None"]
    assert len(alone) == 2 and a in alone


def test_crowded_families_have_the_same_groups(spark):
    rng = random.Random(9)
    texts = []
    for family in range(3):  # one centre's copies, chains away from it, and texts just too far
        words = [f"f{family}w{k}" for k in range(240)]
        texts += [" ".join(edited(rng, words, 1 + k % 6)) for k in range(25)]
        chain = words
        for _ in range(6):
            chain = edited(rng, chain, 4)
            texts.append(" ".join(chain))
    texts = dict(enumerate(texts))
    want, pairs = plain_kept(texts)
    assert len(pairs) > 100 and len(want) > 3
    df = odd_docs(spark, list(texts.values()))
    for crowd in (1000, 8, 3):
        rows, groups, row = similar.grouped(df, crowd=crowd)
        named = rows.join(groups, rows[row] == groups["_r"]).collect()
        least = {}
        for r in named:
            least[r["_g"]] = min(r.doc_id, least.get(r["_g"], r.doc_id))
        assert set(least.values()) == want, crowd
