"""Trees higher than one climb, and proofs that tell what was changed."""

import brute
import pytest

from pairsignals.llm import merkle


@pytest.mark.parametrize("levels", [1, 3])
def test_climbs_of_few_levels_give_the_same_tree(spark, monkeypatch, levels):
    docs = [(k, None, ("a", "b", None, "c")[min(3, k % 11)], k, f"t{k}") for k in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string")
    monkeypatch.setattr(merkle, "LEVELS", levels)
    got = merkle.manifest(df)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute.op11(docs))


@pytest.mark.parametrize("docs", [
    [(1, "s", "en", 3, "abc")],
    [(1, "s", "en", 3, "abc"), (2, "s", "de", None, None)],
    [(1, "s", None, 3, "abc"), (1, "s", None, 3, "abc"), (None, None, None, None, None)],
])
def test_very_small_manifests(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string")
    got = sorted((tuple(r) for r in merkle.manifest(df).collect()), key=str)
    assert got == sorted(brute.op11(docs), key=str)
