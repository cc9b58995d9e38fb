"""SimHash near-dedup with a binary trie self-join.

A document's 64-bit fingerprint has each bit that over half of its shingles'
hashes have. Fingerprints that differ in at most ``max_bits`` bits are linked,
and linked documents form components.

Equal fingerprints are one fingerprint for the join, so a group of copies of
any size costs one row. Fingerprints within two bits agree on two of their
four 16-bit blocks at least; each of the six pairs of blocks deals them to
tries, and a trie is joined with itself by walking pairs of nodes down
together: differing bits add up, and a pair over the budget is dropped. A
fingerprint has at most 64 + 64 * 63 / 2 others within two bits, so links
grow with the fingerprints, not with their square. A block pair shared by very many fingerprints is
dealt once more, by parts of the other two blocks (one of three parts agrees
within two bits).

A NULL or empty text, or one without words, has fingerprint zero and links as
any other. A NULL key counts as no key: a component's id is the smallest key
that is not NULL. Repeated rows are linked like copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsignals.llm.common import LOWER_BYTES, map_arrow, map_texts, written
from pairsignals.llm.components import components

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: Fingerprints that one trie holds at most, unless dealt once more.
TRIE = 20_000
#: Pairs of 16-bit blocks (0 is the lowest).
PAIRS = list(combinations(range(4), 2))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return 0
    flat = b" ".join(words)
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        hashes = [digest(flat, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:n - 1].tolist()]
        hashes = [digest(flat[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]
    # Little-endian bytes, lowest bit first: column i counts bit i.
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    on = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(on, bitorder="little").view("<i8")[0])


def mark_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key``, ``mark`` (hash of the text) and ``fp`` (long) of every row."""
    rows = df.select(F.col(key).alias("key"), mark_of(F.col(text)).alias("mark"), F.col(text).alias("text"))
    return map_texts(rows, {"key": "long", "mark": "long"}, "text", lambda t: (fingerprint(t, shingle),), {"fp": "long"})


def trie_pairs(group: np.ndarray, value: np.ndarray, bits: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group whose values differ in at most ``budget``
    of their low ``bits`` bits. Rows are sorted by (group, value), all different.

    All tries are walked level by level. A node is the run of rows with equal
    leading bits; a pair of nodes splits into pairs of their halves.
    """
    key = (group.astype(np.uint64) << np.uint64(bits)) | value.astype(np.uint64)
    roots = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
    a0, a1 = roots[:-1], roots[1:]
    keep = a1 - a0 > 1
    a0, a1 = a0[keep], a1[keep]
    b0, b1, diff = a0, a1, np.zeros(len(a0), np.int64)
    for level in range(bits - 1, -1, -1):
        if not len(a0):
            break
        bit = np.uint64(1 << level)
        prefix = ~np.uint64((1 << (level + 1)) - 1)

        def middle(lo):  # where the rows of a node begin to have this bit
            return np.searchsorted(key, (key[lo] & prefix) | bit)

        am, bm, same = np.clip(middle(a0), a0, a1), np.clip(middle(b0), b0, b1), a0 == b0
        parts = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1),
                 (am[~same], a1[~same], b0[~same], bm[~same], diff[~same] + 1)]
        a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*parts))
        keep = (a1 > a0) & (b1 > b0) & (diff <= budget) & ((a0 != b0) | (a1 - a0 > 1))
        a0, a1, b0, b1, diff = a0[keep], a1[keep], b0[keep], b1[keep], diff[keep]
    return a0, b0


def dealt(distinct: DataFrame, trie: int = TRIE) -> DataFrame:
    """Each fingerprint under six keys (``pair`` of blocks, ``k`` their bits)
    with ``rest``, the other two blocks; ``sub`` and ``part`` deal a key
    of more than ``trie`` fingerprints once more."""
    def block(i: int) -> Column:
        return F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF)

    def two(i: int, j: int) -> Column:
        return F.shiftleft(block(j), 16).bitwiseOR(block(i))

    keys = [F.struct(F.lit(p).alias("pair"), two(i, j).alias("k"), two(*sorted({0, 1, 2, 3} - {i, j})).alias("rest"))
            for p, (i, j) in enumerate(PAIRS)]
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("x")).select("fp", "x.*")
    large = keyed.groupBy("pair", "k").agg(F.count("*").alias("n")).where(F.col("n") > trie)
    once = F.array(F.struct(F.lit(0).alias("sub"), F.lit(0).cast("long").alias("part")))
    again = F.array(*[F.struct(F.lit(s).alias("sub"), F.shiftrightunsigned("rest", at).bitwiseAND(mask).alias("part"))
                      for s, (at, mask) in enumerate(((21, 0x7FF), (10, 0x7FF), (0, 0x3FF)), 1)])
    return keyed.join(large, ["pair", "k"], "left").select(
        "fp", "pair", "k", "rest", F.explode(F.when(F.col("n").isNull(), once).otherwise(again)).alias("x")).select(
        "fp", "pair", "k", "rest", "x.*")


def linked(distinct: DataFrame, max_bits: int = MAX_BITS, trie: int = TRIE) -> DataFrame:
    """Pairs (u, v) of different fingerprints that differ in at most
    ``max_bits`` bits (two at most)."""
    if not 0 <= max_bits <= 2:
        raise ValueError("blocks are chosen for at most two differing bits")
    keys = ["pair", "k", "sub", "part"]
    n = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tries = dealt(distinct, trie).repartition(n, *keys).sortWithinPartitions(*keys, "rest").select(*keys, "rest", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 6
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)])
                    for h, c in zip(held, batch.columns)]
            # The last trie may go on in the next batch.
            same = np.logical_and.reduce([h == h[-1] for h in held[:4]])
            end = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if end:
                yield joined([h[:end] for h in held])
                held = [h[end:] for h in held]
        if len(held[0]):
            yield joined(held)

    def joined(rows: list[np.ndarray]) -> pa.RecordBatch:
        new = np.logical_or.reduce([np.diff(c) != 0 for c in rows[:4]])
        a, b = trie_pairs(np.concatenate([[0], np.cumsum(new)]), rows[4], 32, max_bits)
        return pa.RecordBatch.from_arrays([pa.array(rows[5][a]), pa.array(rows[5][b])], names=["u", "v"])

    # A pair can meet in several tries.
    return map_arrow(tries, run, "u long, v long").select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """Of every row: ``key``, ``mark`` (hash of the text), ``fp``, ``root`` (a fingerprint that stands for its
    component) and ``component_id`` (smallest key reachable)."""
    rows = written(fingerprints(df, key, text, shingle), "simhash")
    distinct = rows.groupBy("fp").agg(F.min("key").alias("first"))
    hung = components(linked(distinct.select("fp"), max_bits))
    roots = distinct.join(hung, distinct["fp"] == hung["u"], "left").select(
        "fp", "first", F.coalesce("v", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(roots.join(least, "root").select("fp", "root", "component_id"), "fp").select(
        F.col("key").alias(key), "mark", "fp", "root", "component_id")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component with all its columns: that of the smallest key (of rows that share it, the one with
    the smallest hash of the text)."""
    best = near_duplicates(df, key, text, shingle, max_bits).groupBy("root").agg(
        F.min(F.struct(F.col(key).alias("key"), "mark")).alias("best")).select("best.*")
    rows = df.withColumn("__mark", mark_of(F.col(text)))
    return rows.join(best, rows[key].eqNullSafe(best["key"]) & (rows["__mark"] == best["mark"]), "left_semi").dropDuplicates(
        [key, "__mark"]).select(*df.columns)


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
