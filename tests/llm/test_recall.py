"""Windows that reach the similarity are found, however their fingerprints differ."""

import random
from collections import Counter

import numpy as np

from lodestrand.llm import decontaminate as d


def test_windows_of_the_similarity_are_found():
    rng, far, pairs = random.Random(7), 0, 0
    items = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(35, 60)))) for k in range(200)]
    index = d.BenchmarkIndex(items)
    for k, text in items:
        for n in (1, 2):
            words = text.split()
            for at in rng.sample(range(len(words)), n):
                words[at] = f"new{rng.randrange(10**6)}"
            one, two = (d.shingles(d.word_units(x), d.SHINGLE) for x in (text, " ".join(words)))
            if d.weighted_similarity(Counter(one.tolist()), Counter(two.tolist())) >= d.SIMILARITY:
                pairs += 1
                far += int(np.bitwise_count(d.packed(d.votes(one)[-1:]) ^ d.packed(d.votes(two)[-1:]))[0]) > 15
                assert [m[0] for m in index.matches("x y " + " ".join(words) + " z", d.SIMILARITY)] == [k]
    assert pairs > 100 and far


def test_windows_at_exactly_the_similarity_are_found():
    words = [f"w{k}" for k in range(49)]  # 45 shingles; changing the fifth word leaves 40 of 50
    index = d.BenchmarkIndex([(0, " ".join(words))])
    words[4] = "other"
    (found,) = index.matches("a " + " ".join(words) + " b", d.SIMILARITY)
    assert found[0] == 0 and found[1] == 0.8 and found[2:] == (1, 49)
    words[9] = "another"
    assert index.matches("a " + " ".join(words) + " b", d.SIMILARITY) == []
