"""Tables of real rows and edge cases, as fixtures that the tests import."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SMALL = "/root/testdata/sf0.001"
A = "the quick brown fox jumps over the lazy dog and runs on to the river bank where it stops to drink"
LINES = "first line of many\nsecond line of many\nthird line of many\nfourth line of many"

#: (doc_id, text): NULLs, empty and blank texts, copies and near copies, repeated rows, shared keys, ties, odd characters.
EDGES = [
    (None, None), (None, A), (10_000, None), (10_001, ""), (10_002, " \t\n \r\n"), (10_003, A), (10_003, A),
    (10_004, A.upper()), (10_005, A + "."), (10_006, LINES), (10_007, LINES + "\n\n" + LINES), (10_008, "x\n" + LINES),
    (10_009, "word"), (10_010, "two words"), (10_011, "\n\n\n\n"), (10_012, "a b c d e " * 30), (10_013, A[:49]),
    (10_014, A[:50]), (10_015, "é" * 60 + " Σίσυφος ΑΣ İ 你好 😀 \x1c\x1f \u2028x\xa0y" + A), (10_016, "<|endoftext|> <s> &amp;"),
    (10_017, "The MIT License. mit license mit license; Apache-License, GNU General Public License"),
    (10_018, "SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 OR MIT) AND BSD-3-Clause\nCC BY-NC 4.0"),
    (10_019, "SPDX-License-Identifier: AND ("), (10_020, A + " " + A), (10_021, "a" * 500), (10_022, "a" * 300),
    (10_023, (A + "\n") * 40), (10_023, "another text under the same key, " + A), (10_024, "| ".join(["abc def"] * 80)),
    (10_029, "x  y\n\nz \n q\t\tw \r\n e\u0085f \u2581g"), (10_030, "x  y\n\nz \n q\t\tw \r\n e\u0085f, don't 'quoted', 3.14, x²."),
    (10_031, "你" * 400 + "好,。 \U0001F468\u200d\U0001F469, " + "=" * 300), (10_032, "\nfirst end\nsecond, third.\n"),
    (10_025, "!?#*$%& " * 60), (10_026, "81"), (10_027, "in 81 ways"), (10_028, "x" * 5000 + " " + A * 200),
]
ITEMS = [(900, "81"), (901, None), (902, ""), (903, " ".join(A.split()[3:14])), (903, " ".join(A.split()[:9])),
         (904, "brown fox jumps"), (905, "no document holds these words at all, none whatsoever, not one")]
PAGES = [(9_000, None, None), (9_001, "", ""), (9_002, "no scheme", "<p>"), (9_003, "http://EXAMPLE.org/es/x?q#f", "a < b &am"),
         (9_003, "http://example.org/es", "<script>x</p>"), (9_004, "https://a.example.org/en/1#x", "<p>x"),
         (9_005, "ftp://org", None), (9_006, "http://x.com/de/", '<a href="http://bad.net/x">b</a>'),
         (9_007, "http://bad.net/y", '<A HREF=//x.com/de/z>z</A><a href="/own">o</a>'), (9_008, "x://y?z/", "<!-- -->"),
         (9_009, "http://good.net/", "<article><p>Text"), (9_010, "http://z.org/a", "<a href='https://good.net/'>g</a>")]


def documents(with_small: bool = True) -> list[tuple]:
    small = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    rows = list(zip(small["doc_id"], small["text"], small["lang"])) if with_small else []
    return rows + [(k, t, None if k is None else "en") for k, t in EDGES]


def write(folder, docs, items, pages) -> str:
    """Tables with further columns, some of them named as operators name theirs."""
    ids, texts, langs = zip(*docs) if docs else ((), (), ())
    n = len(docs)
    pq.write_table(pa.table({
        "doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()),
        "source": pa.array(["s"] * n), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()),
        "n_words": pa.array(["clash"] * n), "key": pa.array(range(n), pa.int32()), "mark": pa.array([None] * n, pa.string()),
        "kept": pa.array(["k"] * n), "fp": pa.array([b"x"] * n), "item_id": pa.array([0.5] * n)}), f"{folder}/documents.parquet")
    ids, texts = zip(*items) if items else ((), ())
    pq.write_table(pa.table({"item_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()),
                             "gram": pa.array(["g"] * len(items)), "words": pa.array([1] * len(items))}),
                   f"{folder}/benchmark.parquet")
    ids, urls, html = zip(*pages) if pages else ((), (), ())
    pq.write_table(pa.table({"page_id": pa.array(ids, pa.int64()), "url": pa.array(urls, pa.string()),
                             "html": pa.array(html, pa.string()), "host": pa.array([1] * len(pages)),
                             "text": pa.array(["t"] * len(pages)), "trust": pa.array([None] * len(pages), pa.string())}),
                   f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def tables(tmp_path_factory):
    """A few real documents and pages, and the edge cases."""
    items = pq.read_table(f"{SMALL}/benchmark.parquet").to_pydict()
    pages = pq.read_table(f"{SMALL}/pages.parquet").to_pydict()
    return write(tmp_path_factory.mktemp("tables"), documents(), [*zip(items["item_id"], items["text"]), *ITEMS],
                 [*zip(pages["page_id"], pages["url"], pages["html"]), *PAGES])


@pytest.fixture(scope="session")
def no_rows(tmp_path_factory):
    return write(tmp_path_factory.mktemp("none"), [], [], [])
