"""Canopies of many near copies, dealt in chunks, and the signature itself."""

import random

import brute
import numpy as np
import pytest

from pairsignals.llm import minhash


def near_copies(n, changed, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    out = [(0, " ".join(base))]
    for k in range(1, n):
        words = list(base)
        for i in rng.sample(range(120), changed(k)):
            words[i] = f"x{rng.randrange(10 ** 6)}"
        out.append((k, " ".join(words)))
    rng.shuffle(out)
    return [(1000 - k, t) for k, t in out]


@pytest.mark.parametrize("chunk_classes", [5, 512])
def test_links_of_a_large_canopy_are_all_found(spark, chunk_classes):
    # Some copies are linked with the base, some only with other copies, some with none.
    docs = near_copies(70, lambda k: (3, 6, 7, 9, 12, 14)[k % 6], 5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = minhash.near_duplicates(df, chunk_classes=chunk_classes)
    want = brute.op12(docs)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert 10 < sum(kept for *_, kept in want) < 60


def test_signatures_estimate_similarity():
    shingler, made = minhash.shingler(2), minhash.signatures()
    texts = [t.encode() for _, t in near_copies(40, lambda k: k, 9)]
    sets = [shingler(t) for t in texts]
    signatures = [made.of(s) for s in sets]
    off = []
    for i in range(40):
        for j in range(i):
            exact = len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
            off.append((signatures[i] == signatures[j]).mean() - exact)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.04


def test_the_second_permutation_is_shifted():
    made = minhash.Signatures(coordinates=16, positions=64)
    one = np.array([5 << 58], np.uint64)
    values = made.of(one)
    assert sorted(made.first.tolist()) == list(range(64)) and len(set(values.tolist())) == 16
    place = int(made.first[5])
    second = minhash.permutation(2, 64)
    assert values.tolist() == [int(second[(place + k) % 64]) for k in range(16)]


def test_common_counts_equal_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (0, 1, 50, 4000, 6000, 7000)]
    got = minhash.common(sets[:3], sets)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:3]]
