"""The pipeline's rows against a plain version of its stages."""

import brute
import corpus_pipeline
import pyarrow.parquet as pq
from corpus_tables import tables  # noqa: F401

from pairsignals.llm import quality


def verdicts(docs):
    return brute.op7_kept(docs, quality.REFERENCES, quality.WORDS, quality.MAX_CLASS_DISTANCE, quality.MAX_WORD_DISTANCE,
                          quality.MIN_CHARS, quality.MIN_WORDS)


def order(key):
    return (key is not None, key or 0)


def line_dedup(docs):
    """(key, text) of each; rows that repeat a document are one."""
    seen, cover = {}, {}
    windows = []
    for key, text in set(docs):
        lines = [(i, x) for i, x in enumerate(text.split("\n")) if brute.PLAIN.search(x)]
        for k in range(len(lines) - 2):
            w = tuple(x for _, x in lines[k:k + 3])
            place = (order(key), text, [i for i, _ in lines[k:k + 3]])
            windows.append((w, place, (key, text)))
    for w, place, _ in windows:
        seen[w] = min(seen.get(w, place), place)
    for w, place, doc in windows:
        if place != seen[w]:
            cover.setdefault(doc, set()).update(place[2])
    out = []
    for key, text in docs:
        gone = cover.get((key, text), set())
        kept = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        out.append(kept)
    return out


def test_pipeline_equals_plain_stages(spark, tables):
    table = pq.read_table(f"{tables}/documents.parquet").to_pydict()
    docs = list(zip(table["doc_id"], table["text"], table["lang"]))
    docs = [d for d, keep in zip(docs, verdicts(docs)) if keep]
    texts = line_dedup([(k, t) for k, t, _ in docs])
    docs = [(k, t) for (k, before, _), t in zip(docs, texts) if t == before or brute.PLAIN.search(t)]
    groups = {}
    for (key, text), (_, fp, root) in zip(docs, brute.op3(docs)):
        groups.setdefault((root, ), []).append((order(key), key, text))
    docs = [min(g)[1:] for g in groups.values()]
    items = pq.read_table(f"{tables}/benchmark.parquet").to_pydict()
    items = [(i, t) for i, t in zip(items["item_id"], items["text"]) if len(brute.words(t)) >= corpus_pipeline.MIN_ITEM_WORDS]
    hit = {k for k, _, n, *_ in brute.op1(docs, items) if n}
    docs = [d for d in docs if d[0] not in hit]
    got = corpus_pipeline.run(spark, tables)
    assert set(got.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    rows = sorted(tuple(r) for r in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert rows == sorted(brute.op9(docs))
    assert 50 < len(rows) < 200


def test_stages_keep_the_columns_of_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, tables)
        assert made.schema.simpleString() == docs.schema.simpleString()
        assert made.count() <= docs.count()
