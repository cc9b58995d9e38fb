"""Quality rules by distribution divergence.

Each document's histograms of character classes and of common words are held
against those of its language, by Jensen-Shannon distance. The references are
fixed (``REFERENCES``): no document that is judged can move them. The allowed
word distance grows as a text gets shorter (``allowed_word_distance``); the
class histogram is judged from ``MIN_CHARS`` characters on.

A language without a reference is held against the least distant one, with
all letters as one class, and its common words are not judged: the list has
none of them. So is a NULL language, whose words are held against the least
distant reference: it may be any of them.

Besides these, simple counts give the base verdict: too few words, or too
many words in repeated five-word windows.

A NULL text has no words. Documents are judged row by row, so rows that
repeat a key each get a verdict.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairsignals.llm.common import map_arrow, slices

#: Common words of English, German, French and Spanish (fixed values).
COMMON = {
    "en": "the of and to in is that for it as with was on are by this be at from or a an",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus à",
    "es": "de la que el en y a los del se las por un para con no una su al es lo",
}
WORDS = sorted({w for text in COMMON.values() for w in text.split()})

#: Classes of characters; each character is of exactly one.
CLASSES = ("lower", "upper", "digit", "space", "line end", "stop", "symbol", "other ASCII", "not ASCII")
_KIND = np.array([
    4 if b == 0x0A else 3 if b in b" \t\r\v\f" else 2 if 0x30 <= b <= 0x39 else 0 if 0x61 <= b <= 0x7A
    else 1 if 0x41 <= b <= 0x5A else 5 if b in b".,;:!?'\"()-" else 6 if b in b"#*$%&|<>@/\\=+_~^{}[]`"
    else 9 if 0x80 <= b < 0xC0 else 8 if b >= 0xC0 else 7 for b in range(256)], np.uint8)

#: Characters of the base count of symbols.
SYMBOLS = b"#*$%&|<>"
#: Words of a repeated window.
WINDOW = 5

MIN_WORDS, MIN_CHARS = 120, 150
#: Greatest distance (0 to 1) from the language's reference that is kept; for words, from ``MIN_WORDS`` words on.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.31, 0.29
#: What a text of n words, fewer than ``MIN_WORDS``, may be more distant: this by 1/sqrt(n) - 1/sqrt(MIN_WORDS).
SHORT_SLACK = 1.0

#: Both histograms of each language, in the order of ``CLASSES`` and of ``WORDS`` with the other words last: sums over
#: the documents of sf0.01 that ``labels`` calls good (en 223, de 37, fr 47, es 34), as ``references`` makes them.
REFERENCES = {
    "en": ([447078, 7743, 271, 91821, 1983, 13265, 11, 0, 62],
           [1301, 0, 1, 272, 2151, 432, 461, 383, 0, 2, 477, 433, 1, 0, 0, 5, 2, 0, 0, 9, 3, 6, 0, 2, 1, 0, 267,
            247, 1, 0, 753, 373, 0, 1, 1128, 1065, 1, 760, 3, 0, 1, 0, 0, 0, 4, 0, 0, 2665, 597, 228, 0, 0, 0,
            0, 0, 0, 1, 0, 0, 1, 0, 0, 842, 5314, 426, 1593, 0, 0, 1, 0, 0, 606, 511, 2, 2, 0, 70692]),
    "de": ([65286, 1030, 11, 12928, 262, 1799, 0, 0, 3272],
           [0, 0, 50, 0, 2, 0, 1, 0, 22, 102, 34, 0, 0, 0, 120, 1, 0, 63, 193, 742, 101, 383, 0, 65, 49, 0, 55,
            0, 1, 0, 0, 1, 86, 70, 214, 0, 64, 1, 1, 0, 1, 0, 0, 0, 108, 64, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
            0, 78, 0, 0, 0, 5, 0, 0, 0, 0, 311, 0, 160, 1, 0, 0, 138, 0, 9939]),
    "fr": ([78485, 1133, 125, 18077, 366, 2657, 6, 0, 9865],
           [1, 0, 0, 47, 2, 1, 0, 1, 84, 0, 0, 0, 0, 79, 0, 1006, 0, 0, 0, 0, 253, 0, 147, 0, 0, 0, 215, 0, 104,
            298, 0, 0, 0, 0, 0, 1, 0, 1, 560, 0, 355, 259, 0, 0, 0, 0, 0, 2, 54, 0, 88, 0, 89, 0, 0, 110, 130,
            102, 0, 0, 0, 72, 1, 2, 0, 1, 180, 0, 0, 135, 0, 0, 1, 0, 0, 0, 14109]),
    "es": ([55036, 912, 90, 11954, 273, 1752, 2, 0, 5930],
           [0, 56, 0, 0, 0, 0, 38, 0, 0, 0, 0, 0, 60, 0, 0, 699, 103, 0, 0, 0, 0, 0, 0, 0, 0, 212, 162, 52, 0,
            0, 0, 0, 0, 0, 0, 0, 0, 0, 364, 103, 0, 0, 33, 122, 2, 0, 65, 0, 0, 0, 0, 53, 0, 0, 79, 0, 269, 0,
            108, 0, 74, 0, 0, 3, 0, 0, 75, 62, 0, 0, 0, 0, 0, 141, 0, 0, 9326]),
}


def measure(text: bytes) -> tuple:
    """Base counts and both histograms of one whole text (UTF-8)."""
    words = text.split()  # bytes: white space is 0x20 and 0x09-0x0D
    n = len(words)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=10)
    chars = sum(map(len, words)) - int(kinds[9])  # continuation bytes stand only in words
    symbols = sum(text.count(s) for s in (SYMBOLS[i:i + 1] for i in range(len(SYMBOLS))))
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    tally = Counter(map(bytes.lower, words))
    found = [tally.get(w, 0) for w in _WORD_BYTES]
    return (n, chars, symbols, again, repeated_words(words), int(kinds[:9].sum()), kinds[:9].tolist(),
            [*found, n - sum(found)])


_WORD_BYTES = [w.encode() for w in WORDS]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows that are found twice or more in the text,
    the first place included."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    # Windows get equal numbers exactly if they are equal: number pairs, step by step.
    windows = ids
    for k in range(1, window):
        pairs = windows[:-1] * len(ids) + ids[k:]
        if k < window - 1:
            windows = np.unique(pairs, return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    covered[:len(twice)] += twice
    covered[window:] -= twice
    return int((np.cumsum(covered) > 0).sum())


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


#: Name of the column that holds a row's features beside the table's own columns.
FEATURES = "__quality"


def measured(df: DataFrame, columns: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """``columns`` unchanged, and the features of each row as one struct."""
    spelled = [f"lang: string, {', '.join(f'{c}: bigint' for c in (*COUNTS, 'n_chars'))}",
               "classes: array<bigint>, commons: array<bigint>"]
    schema = T.StructType([*(df.schema[c] for c in columns),
                           T.StructField(FEATURES, T.DataType.fromDDL(f"struct<{', '.join(spelled)}>"))])
    longs = pa.list_(pa.int64())
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [measure(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in part.column(n)]
            values = list(zip(*rows))
            features = pa.StructArray.from_arrays(
                [part.column(n + 1), *(pa.array(c, pa.int64()) for c in values[:6]),
                 pa.array(values[6], longs), pa.array(values[7], longs)],
                names=["lang", *COUNTS, "n_chars", "classes", "commons"])
            yield pa.RecordBatch.from_arrays([*part.columns[:n], features], names=[*columns, FEATURES])

    language = F.col(lang).cast("string") if lang in df.columns else F.lit(None).cast("string")
    return map_arrow(df.select(*columns, F.col(text).cast("binary").alias("__text"), language.alias("__lang")), run,
                     schema)


def references(features: DataFrame) -> DataFrame:
    """One row for each language: the sums of both histograms over the given documents. ``REFERENCES`` are fitted by
    this on labelled documents; no query sums up the documents it judges."""
    f = features.select(f"{FEATURES}.*")
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))]
    sums += [F.sum(F.col("commons")[i]).alias(f"w{i}") for i in range(len(WORDS) + 1)]
    return f.groupBy("lang").agg(*sums).select(
        "lang", F.array(*[f"c{i}" for i in range(len(CLASSES))]).alias("classes"),
        F.array(*[f"w{i}" for i in range(len(WORDS) + 1)]).alias("commons"))


def shares(counts: Column, total: Column) -> Column:
    """Counts as shares of their sum; NULL if they sum to nothing."""
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2: 0 to 1) of two arrays of shares."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def fixed(counts: list[int]) -> Column:
    """A reference's counts as shares."""
    return F.array(*[F.lit(c / sum(counts)) for c in counts])


#: Classes that hold letters, in languages of any script.
LETTERS = [CLASSES.index(c) for c in ("lower", "upper", "not ASCII")]


def letters_as_one(counts):
    """A class histogram (values or columns) with all letters in one class."""
    return [sum(counts[i] for i in LETTERS), *(counts[i] for i in range(len(CLASSES)) if i not in LETTERS)]


def distances(f: Column) -> tuple[Column, Column]:
    """Class and word distance of the features ``f`` from the reference of their language."""
    classes, commons = shares(f["classes"], f["n_chars"]), shares(f["commons"], f["n_words"])
    merged = shares(F.array(*letters_as_one(f["classes"])), f["n_chars"])
    of_class = F.least(*[distance(merged, fixed(letters_as_one(c))) for c, _ in REFERENCES.values()])
    of_words = F.when(f["lang"].isNull(), F.least(*[distance(commons, fixed(w)) for _, w in REFERENCES.values()]))
    for lang, (c, w) in REFERENCES.items():
        of_class = F.when(f["lang"] == lang, distance(classes, fixed(c))).otherwise(of_class)
        of_words = F.when(f["lang"] == lang, distance(commons, fixed(w))).otherwise(of_words)
    return of_class, of_words


def allowed_word_distance(n_words: Column, at_length: float = MAX_WORD_DISTANCE) -> Column:
    """Few words make a histogram that differs by chance, by about 1/sqrt(n). No common word at all (a distance of
    0.36 to 0.37) fails from about 36 words on; below, only odd shares of those that are found do."""
    n = F.greatest(n_words, F.lit(1))
    return at_length + SHORT_SLACK * F.greatest(1 / F.sqrt(n) - MIN_WORDS ** -0.5, F.lit(0.0))


def with_verdicts(df: DataFrame, columns: list[str], text: str = "text", lang: str = "lang",
                  max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE,
                  ) -> DataFrame:
    """``columns`` of every row and the struct ``__verdict``: counts, both distances (NULL for a text without
    characters or words; the word distance also for a language without reference), ``base_failed`` by the counts, and
    ``kept`` unless that or a distance fails it.
    """
    f, d = F.col(FEATURES), F.col("__distance")
    of_class, of_words = distances(f)
    both = measured(df, columns, text, lang).select(
        *columns, FEATURES,
        F.struct(of_class.alias("class_distance"), of_words.alias("word_distance")).alias("__distance"))
    failed = (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])
    # A distance that says nothing (NULL) fails no row, whatever the other one says.
    odd = (F.coalesce((f["word_chars"] >= MIN_CHARS) & (d["class_distance"] > max_class_distance), F.lit(False))
           | F.coalesce(d["word_distance"] > allowed_word_distance(f["n_words"], max_word_distance), F.lit(False)))
    return both.select(*columns, F.struct(
        f["lang"].alias("lang"), *(f[c].alias(c) for c in COUNTS),
        F.round(d["class_distance"], 6).alias("class_distance"), F.round(d["word_distance"], 6).alias("word_distance"),
        failed.alias("base_failed"), (~failed & ~odd).alias("kept")).alias("__verdict"))


def judged(df: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``key`` and the verdict of every document."""
    return with_verdicts(df, [key], **options).select(key, "__verdict.*")


def kept(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` that pass, with all their columns."""
    return with_verdicts(df, df.columns, **options).where("__verdict.kept").select(*df.columns)
