"""Every corpus query against a plain version, over real rows and edge cases."""

import math

import brute
import pyarrow.parquet as pq
import pytest
from corpus_tables import SMALL, no_rows, tables  # noqa: F401

from pairsignals.llm import catalog



def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else int(value)
    return value


def rows(df, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.select(*columns).collect()), key=str)


def read(folder, name, *columns):
    table = pq.read_table(f"{folder}/{name}.parquet", columns=list(columns)).to_pydict()
    return list(zip(*(table[c] for c in columns)))


COLUMNS = {
    "op1_decontaminate": ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"),
    "decontaminate_proximity": ("doc_id", "n_items", "items_sha256"),
    "op2_license_scan": ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"),
    "op3_simhash": ("doc_id", "fingerprint", "component_id"),
    "op7_quality_rules": ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
    "op8_url_filter": ("page_id", "host", "path", "rule"),
    "op9_byte_bpe": ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"),
    "op10_suffix_dedup": ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"),
    "op11_merkle_manifest": ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"),
    "op12_minhash": ("doc_id", "n_shingles", "component_id", "kept"),
    "op13_token_align": ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"),
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query_equals_plain_version(spark, tables, name):
    docs = read(tables, "documents", "doc_id", "text")
    plain_version = getattr(brute, name.removeprefix("decontaminate_").split("_")[0])
    if name.startswith(("op1_", "decontaminate_")):
        want = plain_version(docs, read(tables, "benchmark", "item_id", "text"))
    elif name.startswith("op8_"):
        want = [r[:4] for r in plain_version(read(tables, "pages", "page_id", "url"), catalog.URL_RULES)]
    elif name.startswith("op11_"):
        want = plain_version(read(tables, "documents", "doc_id", "source", "lang", "n_chars", "text"))
    else:
        want = plain_version(docs)
    assert rows(catalog.QUERIES[name](spark, tables), COLUMNS[name]) == sorted(want, key=str)


def test_token_files_hold_all_ids_in_key_order(spark, tables):
    got = [tuple(r) for r in catalog.op5_token_files(spark, tables).collect()]
    docs = read(tables, "documents", "doc_id", "text")
    # Rows that share a key may stand in any order, so keys are compared without place, then places on their own.
    want = brute.op5([(-1 if k is None else k, t) for k, t in docs])
    assert sorted((-1 if k is None else k, n, crc) for k, _, n, crc in got) == sorted((k, n, c) for k, _, n, c in want)
    got.sort(key=lambda r: r[1])
    assert [r[0] is not None and r[0] for r in got] == sorted(r[0] is not None and r[0] for r in got)
    assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]
    single = {k for k, _ in docs if k is not None and sum(x == k for x, _ in docs) == 1}
    assert {r for r in got if r[0] in single} == {r for r in want if r[0] in single}


@pytest.mark.parametrize("name", [*catalog.QUERIES, "pipeline"])
def test_empty_tables_give_no_rows(spark, no_rows, name):
    import corpus_pipeline
    query = {**catalog.QUERIES, "pipeline": corpus_pipeline.run}[name]
    assert query(spark, no_rows).collect() == []


@pytest.mark.parametrize("key", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, key):
    import duckdb
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    want = con.execute(catalog.ORACLE_SQL[key])
    columns = [d[0] for d in want.description]
    got = catalog.QUERIES[key](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want.fetchall())
