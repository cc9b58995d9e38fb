"""Parts of the operators on their own."""

import random

import brute
import numpy as np
import pytest
from corpus_tables import tables  # noqa: F401

from pairsignals.llm import (byte_bpe, catalog, decontaminate, html_text, huffman, licenses, quality, simhash,
                             suffix_dedup, token_files, url_filter)
from pairsignals.llm.components import components


def test_byte_bpe_equals_ranks_on_odd_texts():
    codec = byte_bpe.Codec(catalog.BYTE_BPE, byte_bpe.public_tokenizers.PATTERN)
    rng = random.Random(3)
    parts = ["a", "aaa", "e", "..", "--", "00", " ", " ", "\n", "\t", "é", "你好", "😀", "\u0301", "the", "'s", "\x1c", "\xa0"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == brute.TIKTOKEN.encode_ordinary(text)
        assert codec.decode(ids).decode() == text
        if text:
            starts, ends = codec.offsets(ids)
            assert starts[0] == 0 and ends[-1] == len(text)
            assert all(a < b for a, b in zip(starts, ends)) and starts == sorted(starts)


def test_encoding_with_offsets(spark):
    df = spark.createDataFrame([(1, "naïve 😀 text"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in byte_bpe.encode_documents(df, catalog.BYTE_BPE, with_offsets=True).collect()}
    assert rows[1].decoded.decode() == "naïve 😀 text" and rows[1].ends[-1] == 12
    assert rows[2].ids == b"" and rows[2].starts == []


def test_word_encoder_equals_tokenizer_on_odd_texts():
    e = token_files.encoder(catalog.WORD_BPE, 1)
    rng = random.Random(4)
    parts = ["a", "Aa", "É", "..", "--", "0", "1", " ", " ", "\n", "\t", "ñ", "e\u0301", "ß", "你好", "😀", "İ", "ΑΣ", "the", "'S",
             "\x1c", "\xa0", "<|endoftext|>", "<", "ǅ", "Ⅳ", "²", "\x85"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(e.encode(text), e.kind).tolist() == e.tokenizer.encode(
            text, add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("n,size", [(1, 5), (2, 50), (300, 5000), (40_000, 300_000)])
def test_huffman_round_trip(n, size):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.pareto(0.5, size).astype(np.int64), n - 1)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=n))
    assert lengths.max() <= huffman.LIMIT and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    code = huffman.Code(lengths)
    runs = rng.multinomial(size, [0.25] * 4)
    data, at, within = code.encode(ids, runs)
    first = np.cumsum(runs) - runs
    bits = np.concatenate([within[f:f + r:7] + 8 * a for f, r, a in zip(first, runs, at)])
    sizes = np.concatenate([np.minimum(7, r - np.arange(0, r, 7)) for r in runs])
    assert (code.decode(data, bits, sizes) == ids).all()


def test_huffman_lengths_are_optimal_without_limit():
    counts = np.array([5, 9, 12, 13, 16, 45])
    assert (huffman.code_lengths(counts) * counts).sum() == 224
    assert huffman.code_lengths(np.array([1, 2, 4, 8, 16, 32]), 3).max() == 3


def test_token_files_with_many_blocks(spark, tables, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 3000)
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id < 100")
    path = token_files.write_token_files(docs, catalog.WORD_BPE, 1)
    assert spark.read.parquet(f"{path}/blocks").count() > 8
    rows = sorted((r.key, r.start, r.n_tokens) for r in token_files.read_token_files(spark, path).collect())
    assert rows == [r[:3] for r in brute.op5([(r.doc_id, r.text) for r in docs.collect()])]


@pytest.mark.parametrize("text,named,free", [
    ("MIT", {"mit"}, True), ("GPL-2.0-only OR MIT", {"gpl-2.0-only", "mit"}, True),
    ("GPL-2.0-only AND MIT", {"gpl-2.0-only", "mit"}, False), ("MIT OR GPL-3.0 AND BSD-2-Clause", {"mit", "gpl-3.0", "bsd-2-clause"}, True),
    ("(MIT OR GPL-3.0) AND GPL-2.0", {"mit", "gpl-3.0", "gpl-2.0"}, False),
    ("Apache-2.0 WITH LLVM-exception", {"apache-2.0 with llvm-exception"}, True), ("MIT and more", {"mit"}, True),
    ("MIT and (more", {"mit"}, True), ("own-terms or what follows", {"own-terms"}, False), ("isc and zlib or so", {"isc", "zlib"}, True),
])
def test_license_expressions(text, named, free):
    for spelled in (text, text.lower()):
        order, _ = licenses.postfix(licenses.expression_tokens(spelled))
        assert licenses.evaluate(order) == (named, free)


def test_operators_in_capitals_are_followed_by_any_identifier():
    order, _ = licenses.postfix(licenses.expression_tokens("MIT AND Own-Terms OR More and less"))
    assert licenses.evaluate(order) == ({"mit", "own-terms", "more"}, False)


@pytest.mark.parametrize("text", ["", "and", "( mit", "or mit", ")"])
def test_no_license_expression(text):
    with pytest.raises(ValueError):
        licenses.postfix(licenses.expression_tokens(text))


def test_license_labels_and_score():
    row = licenses.scan(b"x\nSPDX-License-Identifier: MIT OR GPL-2.0 # c\nAll Rights Reserved")
    assert row[5] == "all-rights-reserved,gpl-2.0,mit" and row[6] == 1.0 and row[7] == ["mit or gpl-2.0"] and row[8]
    assert licenses.scan(b"plain text")[6] == 0.0
    assert 0 < licenses.scan(b"under the MIT license")[6] < 1


def test_simhash_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    center = rng.integers(0, 1 << 63, 6, np.uint64)
    fps = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), False)) for c in center for _ in range(60)]
    fps += [0, 1, 3, 7, (1 << 64) - 1, (1 << 63)]
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for trie in (simhash.TRIE, 3):  # also with keys dealt once more
        assert {tuple(r) for r in simhash.linked(df, 2, trie).collect()} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 30)] + [(50, 50), (61, 60), (62, 61)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 100 for i in range(101, 141)} | {i: 1 for i in range(2, 30)} | {61: 60, 62: 60}
    assert got == want


def test_one_of_each_keeps_the_smallest_key(spark):
    rows = [(3, "a b c d", "x"), (2, "a b c d", "y"), (2, "a b c d", "y"), (7, "other words stand here", "z"), (None, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((str(r.doc_id), r.source) for r in simhash.one_of_each(df).collect())
    assert got == [("2", "y"), ("7", "z"), ("None", "n")]


def test_suffix_dedup_of_texts_longer_than_a_chunk(spark, monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    base = " ".join(rng.choice(words) for _ in range(900))
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) + base[s:s + rng.randint(10, 2500)])
            for i, s in enumerate(rng.randint(0, 2000) for _ in range(40))] + [(50, base * 2), (51, "ab" * 900), (52, "ab" * 100)]
    whole = list(suffix_dedup.chunks([t.encode() for _, t in docs]))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    monkeypatch.setattr(suffix_dedup, "_powers", {})
    cut = list(suffix_dedup.chunks([t.encode() for _, t in docs]))
    assert len(cut) > 10 * len(whole)
    for found in (whole, cut):  # each window of each text once
        starts = sorted((r, a + s) for c in found for r, lo, hi, s in zip(c.row, c.lo, c.hi, c.shift) for a in range(lo, hi))
        assert starts == [(r, a) for r, (_, t) in enumerate(docs) for a in range(len(t.encode()) - 49)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in suffix_dedup.digest(suffix_dedup.without_repeated_windows(df)).collect())
    assert got == sorted(brute.op10(docs))


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha beta z z z z gamma"), (3, "gamma beta alpha"),
                                  (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma"), (8, None)], "item_id long, text string")
    windows = decontaminate.test_windows(items)
    near = decontaminate.proximity_matches(docs, windows, span=5)
    assert {(r.key, r.item_id) for r in near.collect()} == {(1, 7), (3, 7)}
    found = decontaminate.searched(docs, windows, "doc_id", "text")
    assert decontaminate.phrase_matches(*found, windows).count() == 0


def test_html_of_pages_without_an_article_element():
    long_ = "Many people came to see the old mill turn again after it had stood still for more than forty years."
    page = (f"<html><head><title>t</title><style>p{{}}</style></head><body><div class='menu'><a href=/>Home</a></div>"
            f"<div><p>{long_} &amp; {long_}</p><p>{long_}\n <b>bold</b><br>text</p></div>"
            f"<div id=comments><p>{long_}</p></div><footer>{long_}</footer><script>if (a<b) x()</script>")
    assert html_text.main_text(page.encode()) == f"{long_} & {long_}\n{long_} bold text"


@pytest.mark.parametrize("page", ["", " ", "<", "<p", "<!-- x", "<script>x", "</p></div>", "a & b", "<a <b>"])
def test_html_odd_pages_do_not_fail(page):
    assert isinstance(html_text.main_text(page.encode()), str)


def test_html_held_out_pages(spark, tables):
    """Pages of the test tables: the article element holds the main text."""
    import html
    import re
    pages = spark.read.parquet(f"{tables}/pages.parquet").where("page_id < 9000").collect()
    right = 0
    for p in pages:
        article = re.search(r"<article>(.*?)(?:</article>|$)", p.html, re.S)
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*$", "", article[1] if article else ""))
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in blocks]
        right += html_text.main_text(p.html.encode()) == "\n".join(b for b in want if b)
    assert right >= 0.98 * len(pages)


def test_quality_finds_junk_and_keeps_labelled_good(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = quality.judged(spark.read.parquet(f"{folder}/documents.parquet")).where("n_words >= 100").collect()
    good = [r for r in rows if labels.get(r.doc_id) == 1]
    bad = [r for r in rows if labels.get(r.doc_id) == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good) and sum(r.kept for r in bad) <= 0.2 * len(bad)


def test_trust_follows_links_and_distrust_their_reverse(spark):
    pages = [(1, "http://good.org/", '<a href="http://friend.net/">f</a>'), (2, "http://friend.net/", "<a href='//pal.net/'>p</a>"),
             (3, "http://pal.net/", ""), (4, "http://spam.com/de/", ""), (5, "http://farm.net/x", '<a href="http://spam.com/de/">s</a>'),
             (6, "http://alone.net/", None), (7, "http://seller.net/", '<a href="http://farm.net/">x</a>')]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judged(df, catalog.URL_RULES).collect()}
    assert [got[i].verdict for i in range(1, 8)] == ["allow", "allow", "allow", "block", "block", "allow", "block"]
    assert got[1].trust > got[2].trust > got[3].trust > 0 and got[4].distrust > got[5].distrust > got[7].distrust > 0
    assert abs(got[2].trust - 0.15 * 0.85) < 1e-6 and got[6].trust == 0
