"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines of a document is hashed; a window that
occurs more than once in the corpus keeps its first place (by document, then
line), and all lines under its later places are removed. Windows overlap, so
covered lines are merged before anything is removed. Lines without a word
neither form windows nor are removed.

A NULL text is an empty one. Texts of fewer than three lines with words have
no window and stay as they are. Rows that repeat a whole document (same key
and text) count as one document and are treated alike; rows of one key with
different texts are different documents, in the order of a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: A line has a word if it has any character that is no ASCII white space.
WORDED = r"[^\x09-\x0D\x20]"


def split_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``mark`` (hash of the text) and ``lines``."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(F.col(key).alias("key"), F.xxhash64(body).alias("mark"),
                     F.split(body, "\n", -1).alias("lines"))


def line_windows(lines: DataFrame) -> DataFrame:
    """One row for each window: its 128-bit hash and the numbers of its lines."""
    worded = F.expr(f"filter(transform(lines, (line, i) -> struct(i, line)), x -> x.line RLIKE r'{WORDED}')")
    spans = F.expr(f"transform(sequence(0, size(worded) - {WINDOW}), k -> slice(worded, k + 1, {WINDOW}))")
    return (lines.withColumn("worded", worded).where(F.size("worded") >= WINDOW)
            # The outer form, as for the other one Spark adds a filter that computes the windows once more.
            .select("key", "mark", F.explode_outer(spans).alias("w"))
            .select("key", "mark", F.expr("w.i").alias("at"), F.array_join("w.line", "\n").alias("body"))
            .select("key", "mark", "at", F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(1), "body").alias("h2")))


def repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``mark`` and ``covered``: numbers of the lines under later
    places of a window.

    First places come from an aggregation that sums up before its shuffle, so
    a window that stands in a third of all documents costs each task a row;
    its places then meet the first one in a join whose large keys Spark splits.
    """
    windows = line_windows(split_lines(df, key, text))
    place = F.struct("key", "mark", "at")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(
        F.col("first") != F.col("last")).drop("last")
    later = windows.join(first, ["h1", "h2"]).where(place != F.col("first"))
    return later.groupBy("key", "mark").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("covered"))


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", counts: str = "lines") -> DataFrame:
    """All columns of ``df``, ``text`` without removed lines, and a struct
    ``counts`` of ``n_lines`` and ``n_removed``."""
    found = repeated_lines(df, key, text)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.withColumn("__mark", F.xxhash64(body))
    both = rows.join(found, rows[key].eqNullSafe(found["key"]) & (rows["__mark"] == found["mark"]), "left")
    body = F.coalesce(rows[text].cast("string"), F.lit(""))
    lines = F.split(body, "\n", -1)
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), found["covered"])
    kept = F.when(found["covered"].isNull(), body).otherwise(
        F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n"))
    return both.select(*[kept.alias(c) if c == text else rows[c] for c in df.columns], F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(found["covered"]), F.lit(0)).cast("long").alias("n_removed")).alias(counts))


#: DuckDB SQL for ``op6_line_dedup``.
SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), windows AS (
  SELECT doc_id, i, lead(i, 1) OVER d AS i1, lead(i, 2) OVER d AS i2,
         line, lead(line, 1) OVER d AS line1, lead(line, 2) OVER d AS line2
  FROM lines WHERE regexp_matches(line, '[^\x09-\x0D\x20]')
  WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), later AS (
  SELECT * FROM windows WHERE line2 IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY line, line1, line2 ORDER BY doc_id, i) > 1
), covered AS (
  SELECT doc_id, i FROM later UNION SELECT doc_id, i1 FROM later UNION SELECT doc_id, i2 FROM later
)
SELECT l.doc_id, count(*) AS n_lines, count(c.i) AS n_removed,
       sha256(coalesce(string_agg(CASE WHEN c.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '')) AS kept_sha256
FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.i = c.i
GROUP BY l.doc_id
"""
