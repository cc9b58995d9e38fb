"""Verdicts that the contracts leave to the method, against plain versions of the method."""

import random
import re

import brute
import pyarrow.parquet as pq
import pytest
from corpus_tables import tables  # noqa: F401

from pairsignals.llm import catalog, licenses, quality, url_filter


def test_quality_verdicts_equal_the_plain_rule(spark, tables):
    held = pq.read_table(f"{tables}/documents.parquet").to_pydict()
    docs = list(zip(held["doc_id"], held["text"], held["lang"]))
    rng = random.Random(1)
    long = [t for _, t, _ in docs if t and len(t) > 300]
    # Other languages than the text's, languages without a reference, shuffled letters, cut and repeated texts.
    for i in range(160):
        text = rng.choice(long)
        words = text.split()
        made = (text, " ".join(words[:rng.randrange(8, 60)]), "".join(rng.sample(text, len(text))), text.upper(),
                re.sub(r"\b(the|of|and|to|in|de|la|der|die|que)\b", "zz", text))[i % 5]
        docs.append((20_000 + i, made, rng.choice(["en", "de", "fr", "es", "it", "EN", None])))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(4)
    got = sorted((str(r.doc_id), r.n_words, r.kept) for r in quality.judged(df).collect())
    kept = brute.op7_kept(docs, quality.REFERENCES, quality.WORDS, quality.MAX_CLASS_DISTANCE, quality.MAX_WORD_DISTANCE,
                          quality.MIN_CHARS, quality.MIN_WORDS)
    want = sorted((str(k), len(brute.PLAIN.findall(t or "")), v) for (k, t, _), v in zip(docs, kept))
    assert got == want
    added = [v for (k, _, _), v in zip(docs, kept) if k is not None and k >= 20_000]
    assert 20 < sum(added) < 140


def test_url_verdicts_equal_plain_ranks(spark):
    rng = random.Random(7)
    hosts = [f"h{i}.net" for i in range(40)] + ["a.org", "b.org", "x.com", "y.com"]
    pages, links = [], brute.Counter()
    for i in range(220):
        src = rng.choice(hosts)
        path = rng.choice(["/de/", "/fr/"]) if src.endswith(".com") else "/p"
        to = [rng.choice(hosts) for _ in range(rng.randrange(4))]
        pages.append((i, f"http://{src}{path}", "".join(f'<a href="https://{t}/q">t</a>' for t in to)))
        links.update((src, t) for t in to if t != src)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(4)
    ruled = {r[0]: r for r in brute.op8([p[:2] for p in pages], catalog.URL_RULES)}
    seeds = {}
    for verdict in ("allow", "block"):
        votes = brute.Counter(r[1] for r in ruled.values() if r[4] == verdict)
        seeds[verdict] = {h: n / sum(votes.values()) for h, n in votes.items()}
    trust = brute.ranks([(a, b, n) for (a, b), n in links.items()], seeds["allow"])
    distrust = brute.ranks([(b, a, n) for (a, b), n in links.items()], seeds["block"])
    seen = set()
    for r in url_filter.judged(df, catalog.URL_RULES).collect():
        t, d = trust.get(r.host, 0.0), distrust.get(r.host, 0.0)
        assert r.trust == pytest.approx(t, rel=1e-4, abs=1e-8) and r.distrust == pytest.approx(d, rel=1e-4, abs=1e-8)
        assert abs(d - t) > 1e-5 or not (d or t)  # no host stands on the threshold
        assert r.verdict == (ruled[r.page_id][4] or ("block" if d > t else "allow"))
        seen.add((r.rule is None, r.verdict))
    assert seen == {(True, "allow"), (True, "block"), (False, "allow"), (False, "block")}


def parsed(tokens):
    """Labels and choice of a whole expression, by recursive descent; None if it is none."""
    at = 0

    def level(ops):
        nonlocal at
        if not ops:
            if at < len(tokens) and tokens[at] == "(":
                at += 1
                inner = level(["or", "and", "with"])
                if inner is None or at >= len(tokens) or tokens[at] != ")":
                    return None
                at += 1
                return inner
            if at >= len(tokens) or tokens[at] in ("or", "and", "with", ")"):
                return None
            at += 1
            return {tokens[at - 1]}, licenses.is_permissive(tokens[at - 1])
        left = level(ops[1:])
        while left is not None and at < len(tokens) and tokens[at] == ops[0]:
            at += 1
            right = level(ops[1:])
            if right is None:
                return None
            if ops[0] == "with":
                left = {f"{x} with {y}" for x in left[0] for y in right[0]}, left[1]
            else:
                left = left[0] | right[0], (left[1] or right[1]) if ops[0] == "or" else (left[1] and right[1])
        return left

    found = level(["or", "and", "with"])
    return found if at == len(tokens) else None


def labels_of(text):
    words, labels, covered = brute.words(text), set(), 0
    phrases = {tuple(p.split()): x for p, x in {**licenses.NOTICES, **licenses.BASE}.items()}
    for phrase, label in phrases.items():
        for i in range(len(words) - len(phrase) + 1):
            if tuple(words[i:i + len(phrase)]) == phrase:
                labels.add(label)
                covered += len(phrase)
    tagged = False
    low = text.translate(brute.UPPER).encode().decode("latin-1")
    for tag in licenses.TAGS:
        for m in re.finditer(re.escape(tag), low):
            tokens = licenses.expression_tokens(text.encode().decode("latin-1")[m.end():].split("\n")[0])
            whole = next((f for k in range(len(tokens), 0, -1) if (f := parsed(tokens[:k]))), None)
            if whole:
                labels |= whole[0]
                tagged = True
    return ",".join(sorted(labels)), 1.0 if tagged else 1.0 - 0.5 ** covered


def test_license_labels_and_scores_equal_plain_search(tables):
    held = pq.read_table(f"{tables}/documents.parquet").to_pydict()["text"]
    rng = random.Random(3)
    words = ["mit", "gpl-2.0-only", "or", "and", "with", "(", ")", "apache-2.0", "bsd-3-clause", "classpath-exception-2.0",
             "MIT", "OR", "AND", "WITH", "more", "Own-Terms"]
    made = [f"x\n{rng.choice(licenses.TAGS)} {' '.join(rng.choice(words) for _ in range(rng.randrange(1, 9)))}\nmit license"
            for _ in range(300)]
    notices = [f"Text {p}. {q}, the end" for p in licenses.NOTICES for q in licenses.BASE]
    tagged = 0
    for text in [*filter(None, held), *made, *notices]:
        got = licenses.scan(text.encode())
        assert (got[5], got[6]) == labels_of(text), text[:200]
        tagged += bool(got[7])
    assert tagged > 100
