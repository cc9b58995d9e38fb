"""MinHash near-dedup with circulant permutations and exact verification.

A document is the set of its distinct word shingles. All ``COORDINATES``
coordinates of its signature come from two permutations of ``POSITIONS``
places: the first one spreads the shingles over the places, the second one is
shifted by one place for each coordinate. So a shingle's values for all
coordinates lie side by side in the second permutation, and a signature is the
least of such stretches, element by element.

Equal sets are one class, whatever their number. Classes with an equal band of
the signature meet in a bucket. A bucket's first class is its head, and the
classes of all buckets with one head form its canopy: any two classes that
share a bucket share a canopy. In a canopy, sets are compared exactly, by the
sizes of their intersections. Classes linked with the head need no comparison
with each other, so a large group of near copies costs one comparison for
each; only the others are held against the whole canopy. A canopy is dealt in
chunks of bounded size, so none lands in one task, and a chunk returns at most
one link for each of its classes, enough to connect what is linked.

At a similarity of exactly 0.8, two documents share none of the ``BANDS``
bands with probability (1 - 0.8^5)^44 = 2.6e-8, at 0.85 with 6e-12. Shingles
are compared by 64-bit hashes.

Rows: NULL texts and texts without words have the empty set, and link with
nothing, each its own component. A text of fewer words than a shingle has its
whole sequence as its only shingle. Rows that repeat a key or a text are
linked like copies; a component's id is its smallest key that is not NULL. A
NULL key is kept only where its component has no other. An empty table gives
no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsignals.llm.byte_bpe import Memo
from pairsignals.llm.common import LOWER_BYTES, map_texts, ship, small, written
from pairsignals.llm.components import components

SHINGLE = 2
#: Similarity from which documents are linked, in percent.
PERCENT = 80
BANDS, ROWS = 44, 5
COORDINATES = BANDS * ROWS
#: Places of the permutations. Shingles of a text that share a place only cost precision of the candidates.
POSITIONS = 1 << 22
#: Classes and shingles that a chunk of a canopy holds, about.
CHUNK_CLASSES, CHUNK_SHINGLES = 512, 1 << 20
#: Words that a worker remembers; longer words than LONG bytes are hashed anew each time.
WORDS, LONG = 500_000, 64
#: Shingles compared at once by a matrix product.
COLUMNS = 4096


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permutation(seed: int, n: int = POSITIONS) -> np.ndarray:
    """A permutation that depends on ``seed`` alone, on every machine."""
    return np.argsort(mixed(np.arange(seed * n, (seed + 1) * n, dtype=np.uint64)), kind="stable").astype(np.uint32)


class Signatures:
    """Circulant MinHash: ``first`` spreads the places, ``second`` is shifted."""

    def __init__(self, coordinates: int = COORDINATES, positions: int = POSITIONS):
        self.first, second = permutation(1, positions), permutation(2, positions)
        self.shift = np.uint64(64 - positions.bit_length() + 1)
        self.stretches = np.lib.stride_tricks.sliding_window_view(
            np.concatenate([second, second[:coordinates - 1]]), coordinates)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        places = self.first[shingles >> self.shift]
        return np.minimum.reduce([self.stretches[places[i:i + 1024]].min(axis=0) for i in range(0, len(places), 1024)])


@lru_cache(maxsize=1)
def signatures() -> Signatures:
    return Signatures()


class Shingler:
    """The set of a text: sorted distinct hashes of its word shingles."""

    def __init__(self, shingle: int = SHINGLE):
        self.shingle = shingle
        self.words = Memo(xxhash.xxh64_intdigest, WORDS)

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.translate(LOWER_BYTES).split()
        if not words:
            return np.empty(0, np.uint64)
        hashes = np.fromiter((self.words[w] if len(w) <= LONG else xxhash.xxh64_intdigest(w) for w in words),
                             np.uint64, len(words))
        size = min(self.shingle, len(words))
        made = hashes[:len(words) - size + 1]
        with np.errstate(over="ignore"):
            for i in range(1, size):  # a shingle's hash depends on the order of its words
                made = mixed(made * np.uint64(0x9E3779B97F4A7C15) + hashes[i:len(words) - size + 1 + i])
        return np.unique(made if size > 1 else mixed(made))


@lru_cache(maxsize=4)
def shingler(shingle: int) -> Shingler:
    return Shingler(shingle)


def class_of(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def bands(shingles: np.ndarray) -> list[int]:
    """A 64-bit hash of each band; equal bands of different places differ."""
    if not len(shingles):
        return []
    rows = signatures().of(shingles).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(rows)]


def mark_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def described(df: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """``key``, ``mark`` (hash of the text), ``class`` (of its set; NULL if
    empty), ``n_shingles`` and the hashes of its ``bands``, of every row."""
    def describe(data: bytes) -> tuple:
        found = shingler(shingle)(data)
        return class_of(found), len(found), bands(found)

    rows = df.select(F.col(key).alias("key"), mark_of(F.col(text)).alias("mark"), F.col(text).alias("text"))
    return map_texts(rows, {"key": "long", "mark": "binary"}, "text", describe,
                     {"class": "binary", "n_shingles": "long", "bands": "array<long>"})


def canopies(classes: DataFrame) -> DataFrame:
    """(``head``, ``class``) for every bucket of several classes, its head
    among them. A bucket is grouped for its head only, and joined back."""
    dealt = classes.select("class", F.explode("bands").alias("bucket"))
    heads = dealt.groupBy("bucket").agg(F.min("class").alias("head"), F.max("class").alias("last")).where(
        F.col("head") != F.col("last")).select("bucket", "head")
    return dealt.join(heads, "bucket").select("head", "class").distinct()


def sets_of(df: DataFrame, wanted: DataFrame, text: str, shingle: int) -> DataFrame:
    """``class`` and ``set`` (binary: sorted hashes) of the classes in
    ``wanted`` (``mark`` of one of its texts, ``class``), one row for each."""
    marked = df.select(mark_of(F.col(text)).alias("mark"), F.col(text).cast("string").alias("text"))
    texts = marked.join(small(wanted), "mark").dropDuplicates(["class"])
    return map_texts(texts, {"class": "long"}, "text", lambda data: (shingler(shingle)(data).tobytes(),), {"set": "binary"})


def common(some: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, as a matrix: products
    of 0/1 matrices, over a bounded number of shingles at a time."""
    values = np.concatenate([*some, *others])
    names, number, times = np.unique(values, return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(some) + len(others)), [len(s) for s in (*some, *others)])
    shared = times[number] > 1
    rows, number = rows[shared], number[shared]
    order = np.argsort(number, kind="stable")
    rows, number = rows[order], number[order]
    left = np.zeros((len(some), len(others)), np.float64)
    at = 0
    while at < len(number):
        # Whole shingles only: each adds to the sum of one block.
        end = int(np.searchsorted(number, number[at] + COLUMNS))
        held = np.zeros((len(some) + len(others), COLUMNS), np.float32)
        held[rows[at:end], number[at:end] - number[at]] = 1
        left += held[:len(some)] @ held[len(some):].T
        at = end
    return left


def similar(some: list[np.ndarray], others: list[np.ndarray], percent: int) -> np.ndarray:
    both = common(some, others)
    sizes = np.array([len(s) for s in some], np.float64)[:, None] + np.array([len(s) for s in others], np.float64)
    return 100 * both >= percent * (sizes - both)


def joined_up(links: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links: each row's smallest row reachable."""
    at, before = np.arange(len(links)), None
    while before is None or (at != before).any():
        before = at
        at = np.where(links, at[None, :], len(links)).min(axis=1, initial=len(links))
        at = np.minimum(np.minimum(before, at), np.minimum(before, at)[np.minimum(before, at)])
    return at


LINKS = "u long, v long, head long"


def found_links(head: int, u: list[int], v: list[int], names: list[int]) -> pa.Table:
    """Links, and the classes (as ``u``, without ``v``) that stay to be compared."""
    kind = pa.int64()
    return pa.table([pa.array(u + names, kind), pa.array(v + [None] * len(names), kind),
                     pa.array([head] * (len(u) + len(names)), kind)], names=["u", "v", "head"])


def within_chunks(rows: DataFrame, percent: int) -> DataFrame:
    """Of each chunk of a canopy: classes linked with the head, links among the
    other classes and between both, and the others themselves."""
    def compare(table: pa.Table) -> pa.Table:
        head = table["head"][0].as_py()
        sets = {c: np.frombuffer(s, np.uint64) for c, s in zip(table["class"].to_pylist(), table["set"].to_pylist())}
        first = sets.pop(head)
        names = sorted(sets)
        if not names:
            return found_links(head, [], [], [])
        near = similar([first], [sets[c] for c in names], percent)[0]
        far = [c for c, x in zip(names, near) if not x]
        order = [c for c, x in zip(names, near) if x] + far
        u, v = order[:len(names) - len(far)], [head] * (len(names) - len(far))
        if far:
            links = np.eye(len(order), dtype=bool)
            part = similar([sets[c] for c in far], [sets[c] for c in order], percent)
            links[len(order) - len(far):] |= part
            links[:, len(order) - len(far):] |= part.T
            for i, j in enumerate(joined_up(links).tolist()):
                if i != j:
                    u.append(order[i])
                    v.append(order[j])
        return found_links(head, u, v, far)

    ship(rows.sparkSession)
    return rows.groupBy("head", "chunk").applyInArrow(compare, LINKS)


def across_chunks(rows: DataFrame, percent: int) -> DataFrame:
    """Links between the ``left`` classes of each pair of parts, which are not
    linked with the head, and the others."""
    def compare(table: pa.Table) -> pa.Table:
        some, others = {}, {}
        for c, s, left in zip(*(table[c].to_pylist() for c in ("class", "set", "left"))):
            (some if left else others)[c] = np.frombuffer(s, np.uint64)
        a, b = sorted(some), sorted(others)
        links = np.zeros((len(a) + len(b),) * 2, bool)
        if a and b:
            links[:len(a), len(a):] = similar([some[c] for c in a], [others[c] for c in b], percent)
            links |= links.T
        names = a + b
        pairs = [(names[i], names[j]) for i, j in enumerate(joined_up(links).tolist()) if names[i] != names[j]]
        return found_links(table["head"][0].as_py(), [p[0] for p in pairs], [p[1] for p in pairs], [])

    ship(rows.sparkSession)
    return rows.groupBy("head", "left_part", "right_part").applyInArrow(compare, LINKS)


def links_of(pairs: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int = PERCENT,
             chunk_classes: int = CHUNK_CLASSES, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """(u, v) of linked classes, enough of them to connect all that are.

    ``pairs`` are the canopies (``head``, ``class``), ``sizes`` has
    ``n_shingles`` and ``sets`` the ``set`` of each class. Only names are
    joined by head, a key that a large canopy shares; sets join by class."""
    def parts(members: DataFrame, name: str) -> DataFrame:
        return members.groupBy("head").agg(F.greatest(
            F.ceil(F.count("*") / chunk_classes), F.ceil(F.sum("n_shingles") / chunk_shingles)).alias(name))

    def part_of(n: str) -> Column:
        return F.pmod(F.xxhash64("class"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))

    sized = written(pairs.join(sizes.select("class", "n_shingles"), "class"), "minhash-sized")
    large = small(parts(sized, "chunks").where("chunks > 1"))
    members = written(sized.join(large, "head", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))),
                      "minhash-canopies")
    # The head meets every chunk, any other class its own.
    dealt = members.select("head", "class", F.explode(F.when(
        F.col("class") == F.col("head"), every("chunks")).otherwise(F.array(part_of("chunks")))).alias("chunk"))
    inner = written(within_chunks(dealt.join(sets, "class"), percent), "minhash-links")
    # A canopy of several chunks: its far classes, in parts of their own, meet all of its chunks.
    far = inner.where("v IS NULL").select("head", F.col("u").alias("class"), F.lit(True).alias("is_far")).distinct()
    wide = members.where("chunks > 1").join(far, ["head", "class"], "left").withColumn("far", F.col("is_far").isNotNull())
    wide = wide.join(small(parts(wide.where("far"), "lefts")), "head")
    left = wide.where("far").select("head", "class", F.lit(True).alias("left"),
                                    part_of("lefts").alias("left_part"), F.explode(every("chunks")).alias("right_part"))
    right = wide.select("head", "class", F.lit(False).alias("left"),
                        F.explode(every("lefts")).alias("left_part"), part_of("chunks").alias("right_part"))
    outer = across_chunks(left.union(right).join(sets, "class"), percent)
    return inner.where("v IS NOT NULL").select("u", "v").union(outer.select("u", "v"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT, chunk_classes: int = CHUNK_CLASSES, chunk_shingles: int = CHUNK_SHINGLES,
                    ) -> DataFrame:
    """Of every row: ``key``, ``n_shingles``, ``component_id`` (smallest key
    reachable) and ``kept`` (it is this one)."""
    rows = written(described(df, key, text, shingle), "minhash")
    # A class is numbered: its number is what buckets, canopies and links hold.
    classes = rows.where("class IS NOT NULL").groupBy(F.col("class").alias("name")).agg(
        F.min("key").alias("first"), F.min("mark").alias("mark"), F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "minhash-classes")
    pairs = written(canopies(classes), "minhash-pairs")
    wanted = written(classes.select("class", "mark", "n_shingles").join(pairs, "class", "left_semi"), "minhash-wanted")
    sets = written(sets_of(df, wanted.select("mark", "class"), text, shingle), "minhash-sets")
    hung = components(links_of(pairs, wanted, sets, percent, chunk_classes, chunk_shingles))
    roots = classes.join(hung, F.col("class") == hung["u"], "left").select(
        "name", "first", F.coalesce("v", "class").alias("root"))
    ids = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(ids, "root").select("name", "component_id")
    found = rows.join(named, F.col("class") == F.col("name"), "left")
    component = F.when(F.col("class").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return found.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"),
                        F.col("key").eqNullSafe(component).alias("kept"))
