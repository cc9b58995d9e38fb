"""Intersected lists against plain versions, on texts of few words, where terms repeat and rarest terms tie."""

import random

import brute
import pytest

from pairsignals.llm import decontaminate


def corpus(seed, vocabulary):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(1, 14))) for i in range(12)] + [(50, "a"), (51, "a a"), (52, "a b a"), (53, "absent a")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, f"{text(9)} {t} {text(9)}") for i, (_, t) in enumerate(items)]
    shuffled = [(200 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, (_, t) in enumerate(items)]
    return docs + shuffled + [docs[3], docs[3], (None, docs[4][1]), (None, None), (7, docs[50][1])], items


@pytest.mark.parametrize("seed, vocabulary, span", [(1, "abc", 10), (2, "abcdefghijklmnop", 13)])
def test_lists_equal_plain_versions(spark, seed, vocabulary, span):
    rows, texts = corpus(seed, vocabulary)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(texts, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.report(docs, items).collect()), key=str)
    assert got == sorted(brute.op1(rows, texts), key=str)
    got = sorted((tuple(r) for r in decontaminate.proximity_report(docs, items, span).collect()), key=str)
    assert got == sorted(brute.proximity(rows, texts, span), key=str)


def test_lists_joined_by_shuffle_give_the_same(spark, monkeypatch):
    rows, texts = corpus(3, "abcdefgh")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(texts, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "small", lambda df: df)
    got = sorted((tuple(r) for r in decontaminate.report(docs, items).collect()), key=str)
    assert got == sorted(brute.op1(rows, texts), key=str)


def test_lists_of_other_terms_are_stored_for_documents_with_starts_only(spark):
    rows = [(1, "one two three four five"), (2, "one x three y five"), (3, "five five five three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    windows = decontaminate.test_windows(spark.createDataFrame([(9, "one two three four")], "item_id long, text string"))
    texts, index, wanted = decontaminate.searched(docs, windows, "doc_id", "text")
    assert {r.term for r in index.collect()} == {"", "two", "four"}
    assert [(r.key, r.start, r.size, r.item_id) for r in decontaminate.phrase_matches(texts, index, wanted, windows).collect()] == [
        (1, 0, 4, 9)]
