"""Benchmark decontamination with a positional inverted index.

A test item is cut into windows of ``window`` consecutive words (a shorter one
is a single window). Corpus occurrences of every test term are counted, and
each window's terms are ordered from the rarest one. The index stores postings
(document, term, position). The list of a window's rarest term, shifted by its
offset, gives possible starts; they are intersected with the shifted list of the
next one, and those left with the lists of all other terms, which are stored for
the documents that hold them. What is left is an exact phrase match. For
``proximity`` the lists meet within a span of words instead.

Everything is built-in DataFrame functions. Tables made from test items grow
with the benchmark only; they are broadcast up to ``BROADCAST_ROWS`` rows
(counted first), and joined by shuffle beyond that. Lists meet on document, term
and place together, so neither a frequent term nor a very long document is one
key. A window that a third of all documents hold costs each of these documents
its own rows, which meet again only by document.

A NULL or empty text has no words; an item without words no window. Rows that
repeat a document (same key and text) count as one; each gets the result. Items that share an id
are one item with the windows of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsignals.llm.common import WORD, ascii_lower, small, written

WINDOW = 10


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def test_windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW,
                 min_words: int = 1) -> DataFrame:
    """``item_id`` and ``gram`` (array of words), each once, of items with ``min_words`` words at least."""
    words = items.select(F.col(key).alias("item_id"), words_of(F.col(text)).alias("words")).where(
        F.size("words") >= min_words).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    return words.select("item_id", "words", F.explode(starts).alias("at")).select(
        "item_id", F.slice("words", F.col("at"), window).alias("gram")).distinct()


def rarest_first(grams: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Windows that can occur: ``id``, ``gram`` and ``order``, its terms with their offsets, rarest first. It is written
    once: counting needs the whole corpus."""
    terms = grams.select(F.explode("gram").alias("term")).distinct()
    # The outer form of explode: for the other one Spark adds a filter that cuts the text into words once more.
    seen = docs.select(F.explode_outer(words_of(F.col(text))).alias("term")).join(small(terms), "term").groupBy("term").agg(
        F.count("*").alias("n"))
    each = grams.select("gram", F.posexplode("gram").alias("offset", "term"))
    found = each.join(seen, "term").groupBy("gram").agg(
        F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("by"))
    # A window with a term that the corpus lacks has fewer entries than words, and is left out.
    return written(found.where(F.size("by") == F.size("gram")).select(
        F.monotonically_increasing_id().alias("id"), "gram",
        F.transform("by", lambda b: F.struct(b["term"].alias("term"), b["offset"].alias("offset"))).alias("order")), "windows")


#: The term of a posting that stands for a whole document; its position is the number of words. No word is empty.
DOCUMENT = ""


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``mark`` (hash of the text) and ``text`` of each document."""
    return docs.select(F.col(key).alias("key"), mark_of(F.col(text)).alias("mark"), F.col(text).alias("text"))


def postings(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """The lists of the given ``term``s: ``key``, ``mark``, ``term`` and ``at`` (word number from 0), and a posting of
    term ``DOCUMENT`` for each document. They are stored in the shared folder."""
    terms = terms.select("term").union(texts.sparkSession.range(1).select(F.lit(DOCUMENT).alias("term"))).distinct()
    words = F.array_append(words_of(F.col("text")), F.lit(DOCUMENT))
    return written(texts.select("key", "mark", F.posexplode_outer(words).alias("at", "term")).join(
        small(terms), "term").select("key", "mark", "term", "at"), "postings")


def terms_of(wanted: DataFrame, which: Column) -> DataFrame:
    return wanted.select(F.explode(which).alias("term")).distinct()


def standing(asked: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of ``asked`` whose ``term`` has a posting ``at`` their place in their document."""
    lists = index.select(*[F.col(c).alias("__" + c) for c in ("key", "mark", "term", "at")])
    return asked.join(lists, F.expr("key <=> __key AND mark = __mark AND term = __term AND at = __at"), "left_semi")


def in_documents(texts: DataFrame, found: DataFrame) -> DataFrame:
    """The texts that hold any of ``found``."""
    held = found.select(F.col("key").alias("__key"), F.col("mark").alias("__mark")).distinct()
    return texts.join(small(held), F.expr("key <=> __key AND mark = __mark"), "left_semi")


def phrase_matches(texts: DataFrame, index: DataFrame, wanted: DataFrame, windows: DataFrame) -> DataFrame:
    """Exact occurrences: ``key``, ``mark``, ``start`` (word number), ``size`` (words) and ``item_id``. The list of a
    window's rarest term gives its starts. They are intersected with the list of the next one, shifted by its offset;
    then, in the documents where starts are left, with the lists of all others."""
    first, second = F.get("order", F.lit(0)), F.coalesce(F.get("order", F.lit(1)), F.get("order", F.lit(0)))
    rarest = wanted.select("id", first["term"].alias("term"), first["offset"].alias("offset"), second.alias("next"))
    starts = index.join(small(rarest), "term").where("at >= offset").select(
        "key", "mark", "id", (F.col("at") - F.col("offset")).alias("start"), F.col("next.term").alias("term"),
        (F.col("at") - F.col("offset") + F.col("next.offset")).alias("at"))
    two = written(standing(starts, index).select("key", "mark", "id", "start").distinct(), "starts")
    lists = postings(in_documents(texts, two), terms_of(wanted, F.expr("slice(order.term, 3, size(order))")))
    each = two.join(small(wanted.select("id", F.size("order").alias("size"), F.expr("slice(order, 3, size(order))").alias("others"))), "id")
    asked = each.select("key", "mark", "id", "start", "size", F.explode("others").alias("of")).select(
        "key", "mark", "id", "start", "size", "of.term", (F.col("start") + F.col("of.offset")).alias("at"))
    names = ["key", "mark", "id", "start", "size"]
    whole = standing(asked, lists).groupBy(*names).agg(F.count("*").alias("n")).where("n = size - 2").select(*names)
    items = windows.join(small(wanted.select("id", "gram")), "gram").select("id", "item_id")
    return whole.unionByName(each.where("size <= 2").select(*names)).join(small(items), "id").drop("id")


def searched(docs: DataFrame, windows: DataFrame, key: str, text: str, terms: Column | str = "order.term",
             ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts, the stored lists of the first two ``terms`` of each window, and the windows that can occur."""
    wanted = rarest_first(windows.select("gram").distinct(), docs, text)
    texts = keyed(docs, key, text)
    return texts, postings(texts, terms_of(wanted, F.slice(terms, 1, 2))), wanted


def proximity_matches(docs: DataFrame, windows: DataFrame, span: int, key: str = "doc_id", text: str = "text",
                      ) -> DataFrame:
    """Places where all words of a window stand, in any order, among ``span`` consecutive words, one of which is an
    occurrence of its rarest word: ``key``, ``mark``, ``at`` (of that word) and ``item_id``. Lists meet by ranges of
    ``span`` words, rarest terms first, so no row meets more than a few ranges of another list."""
    texts, index, wanted = searched(docs, windows, key, text, F.array_distinct("order.term"))
    needs = wanted.select("id", F.array_distinct("order.term").alias("needs"))
    rarest = index.join(small(needs.withColumn("term", F.get("needs", F.lit(0)))), "term").select(
        "key", "mark", "id", "at", F.coalesce(F.get("needs", F.lit(1)), "term").alias("term"))
    two = written(beside(rarest, index, span, "left_semi").select("key", "mark", "id", "at").distinct(), "places")
    lists = postings(in_documents(texts, two), terms_of(wanted, F.col("order.term")))
    asked = two.join(small(needs), "id").select("key", "mark", "id", "at", F.size("needs").alias("n"),
                                                F.explode("needs").alias("term"))
    near = beside(asked, lists, span, "inner").groupBy("key", "mark", "id", "at", "n").agg(
        F.collect_set(F.struct(F.col("__at").alias("at"), F.col("__term").alias("term"))).alias("places"))
    whole = F.exists(F.sequence(F.col("at") - (span - 1), "at"), lambda s: F.size(F.array_distinct(F.transform(
        F.filter("places", lambda p: p["at"].between(s, s + span - 1)), lambda p: p["term"]))) == F.col("n"))
    items = windows.join(small(wanted.select("id", "gram")), "gram").select("id", "item_id")
    return near.where(whole).select("key", "mark", "id", "at").join(small(items), "id").drop("id").distinct()


def beside(asked: DataFrame, index: DataFrame, span: int, how: str) -> DataFrame:
    """Rows of ``asked`` with postings of their ``term`` less than ``span`` words away from ``at``, one for each posting
    (``__at``) where ``how`` is inner."""
    lists = index.select(*[F.col(c).alias("__" + c) for c in ("key", "mark", "term", "at")]).withColumn(
        "__range", F.floor(F.col("__at") / span))
    ranges = asked.withColumn("range", F.explode(F.sequence(
        F.floor((F.col("at") - (span - 1)) / span), F.floor((F.col("at") + (span - 1)) / span))))
    return ranges.join(lists, F.expr("key <=> __key AND mark = __mark AND term = __term AND range = __range")
                       & (F.abs(F.col("at") - F.col("__at")) < span), how).drop("range", "__range")


def hits_by_document(index: DataFrame, matches: DataFrame) -> DataFrame:
    """For each document: ``key``, ``mark``, ``n_words``, ``n_hit`` (words under any match) and ``items`` (ids found,
    each once). Documents that are repeated give as many rows."""
    rows = index.where(F.col("term") == DOCUMENT).select(
        "key", "mark", F.col("at").alias("n_words"), F.lit(1).alias("one"))
    found = matches.select("key", "mark", F.struct("start", (F.col("start") + F.col("size")).alias("stop")).alias("span"),
                           "item_id")
    # Arrays leave NULLs out, so a document without matches has empty ones.
    each = rows.unionByName(found, allowMissingColumns=True).groupBy("key", "mark").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count("one").alias("n"),
        F.array_sort(F.collect_set("span")).alias("spans"), F.collect_set("item_id").alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(x["stop"] - F.greatest(x["start"], a["reach"]), F.lit(0))).cast("long").alias("n"),
            F.greatest(x["stop"], a["reach"]).alias("reach")), lambda a: a["n"])
    return each.select("key", "mark", "n_words", covered.alias("n_hit"), "items",
                       F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")).drop("copy")


def without_matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                    min_words: int = 1) -> DataFrame:
    """The rows of ``docs`` without any window of an item of ``min_words`` words at least."""
    windows = test_windows(items, window=window, min_words=min_words)
    texts, index, wanted = searched(docs, windows, key, text)
    found = phrase_matches(texts, index, wanted, windows).select("key", "mark").distinct()
    rows = docs.withColumn("__mark", mark_of(F.col(text)))
    return rows.join(found, rows[key].eqNullSafe(found["key"]) & (rows["__mark"] == found["mark"]), "left_anti").select(
        *docs.columns)


def mark_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its words, the words under matches and the items they belong to."""
    windows = test_windows(items)
    texts, index, wanted = searched(docs, windows, key, text)
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return hits_by_document(index, phrase_matches(texts, index, wanted, windows)).select(
        F.col("key").alias(key), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def proximity_report(docs: DataFrame, items: DataFrame, span: int = 2 * WINDOW, key: str = "doc_id", text: str = "text",
                     ) -> DataFrame:
    """Documents with any window of an item in any order among ``span`` words: their items, and the digest of those.
    Rows that repeat a document (same key and text) are one row."""
    found = proximity_matches(docs, test_windows(items), span, key, text).groupBy("key", "mark").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return found.select(F.col("key").alias(key), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))


#: DuckDB SQL for ``op1_decontaminate``.
SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, list_slice(w, s, s + 9) AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM items WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS gram
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s
        FROM docs, (SELECT DISTINCT len(gram) AS n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, s, n, item_id FROM grams JOIN windows USING (gram)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
