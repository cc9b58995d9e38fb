"""Removal of repeated windows by content anchors and hash groups.

This stands in place of a depth-limited radix sort of suffixes: no suffix is
ordered. Windows are grouped in passes; after each pass those that stand alone
are left out, and after the last one equal groups are the repeated windows of
``THRESHOLD`` bytes. A window of a document is removed if its group has a
document with a smaller key.

What a pass groups by is not the 1st, 2nd, ... byte of a suffix, but parts of
its window that the content chooses, so that neighbouring suffixes share the
rows of the first passes:

1. The anchor: the ``ANCHOR``-byte string of the window with the smallest
   hash (the leftmost of equals). Equal windows have equal anchors at equal
   offsets, and neighbouring windows mostly have the same, so one row stands
   for a run of windows. Anchors of a single document end here.
2. The stretch: all bytes of a run. Windows of equal stretches are equal one
   by one; the smallest document of each stretch is found, and the windows of
   the others are removed.
3. The windows themselves, only of runs whose anchor has several different
   stretches, and only in the smallest document of each stretch.

Keys are hashes: 48 bits for anchors, which only choose candidates, 95 bits
for stretches and windows.

Before the passes, texts that are equal as a whole are found by their hashes
(128 bits): a copy of a document with a smaller key is removed entirely and
takes no part in them.

Documents that are read together form a batch of bounded size, one row with
its texts compressed; all passes read the batches from one shuffle. A pass
sends each different key of a batch once, with its smallest document there,
so a string that a third of all documents hold costs one entry for a batch,
and entries are dealt evenly by their hash. They travel sorted, in byte
planes of binary columns, which Spark's shuffle compresses well.

A NULL text is an empty one; texts shorter than ``THRESHOLD`` bytes lose
nothing. Rows that repeat a key do not remove from each other; a NULL key
counts as the smallest. Each row gets its own result.
"""

from __future__ import annotations

import hashlib
import inspect
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsignals.llm.common import give_back, ship, small, written

THRESHOLD = 50
#: Bytes of an anchor: longer ones choose fewer windows for the last pass, shorter ones make fewer rows in the first.
ANCHOR = 28
#: Text bytes of a batch at most (one text at least), and of what is merged in one task of a pass, about. They size
#: tasks, not results.
BATCH_BYTES, MERGE_BYTES = 2 << 20, 8 << 20
#: Texts with copies up to which their table (three numbers a row) is broadcast; more are joined by shuffle.
COPIES = 2_000_000
#: Bytes hashed at once, few enough for a processor's cache; longer texts are cut into overlapping pieces. Positions
#: must fit 24 bits.
CHUNK = 1 << 17

_U = np.uint64
_LOW = _U((1 << 24) - 1)
_SIGN = _U(1 << 63)
#: Odd multipliers of two polynomial hashes, and random values of the bytes for each.
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_BYTES = tuple(np.frombuffer(hashlib.shake_256(bytes([i])).digest(2048), "<u8") for i in (1, 2))
_powers: dict[int, np.ndarray] = {}


def powers(base: int) -> np.ndarray:
    """Powers of a number modulo 2^64, for each position of a chunk."""
    if base not in _powers:
        out = np.full(CHUNK + 1, base, _U)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all its bits."""
    h = (h ^ (h >> _U(32))) * _U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


class Hashes:
    """Hash of any stretch of a byte array, each in constant time: a difference of sums over
    ``value[byte] * base ** -position``, times ``base ** start``."""

    def __init__(self, data: np.ndarray, which: int):
        base = _BASES[which]
        terms = _BYTES[which][data]
        terms *= powers(pow(base, -1, 1 << 64))[:len(data)]
        self.up, self.sums = powers(base), np.concatenate([np.zeros(1, _U), np.cumsum(terms)])

    def of(self, start, stop) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.up[start])


class Chunk:
    """Pieces of texts side by side, and their runs of windows with one anchor.

    ``row``: the text of each run; ``lo``, ``hi``: its window starts;
    ``shift``: what makes a position one in the text; ``anchor``: 48-bit key.
    """

    def __init__(self, pieces: list[tuple[int, int, bytes]]):
        self.data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        ends = np.cumsum([len(p[2]) for p in pieces])
        begins = ends - [len(p[2]) for p in pieces]
        n = len(self.data)
        at = slice(0, n - ANCHOR + 1)
        self.first = Hashes(self.data, 0)
        key = self.first.of(at, slice(ANCHOR, n + 1))
        # The hash's upper 40 bits decide; the position below them makes it the leftmost of equals.
        least = (key & ~_LOW) | np.arange(len(key), dtype=_U)
        span, want = 1, THRESHOLD - ANCHOR + 1
        while span < want:
            step = min(span, want - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        chosen = (least & _LOW).astype(np.int64)
        start = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
        stop = np.append(start[1:], len(chosen))
        spot = chosen[start]
        piece = np.searchsorted(ends, spot, side="right")
        start, stop = np.maximum(start, begins[piece]), np.minimum(stop, ends[piece] - THRESHOLD + 1)
        keep = start < stop  # windows that cross from one piece to the next are none
        self.lo, self.hi, piece = start[keep], stop[keep], piece[keep]
        self.anchor = key[spot[keep]] >> _U(16)
        self.row = np.array([p[0] for p in pieces], np.int64)[piece]
        self.shift = (np.array([p[1] for p in pieces], np.int64) - begins)[piece]

    def pick(self, keep: np.ndarray) -> None:
        self.lo, self.hi, self.anchor, self.row, self.shift = (
            x[keep] for x in (self.lo, self.hi, self.anchor, self.row, self.shift))

    def keys(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """95-bit keys of stretches, in two parts; the lowest bit is left free for a flag."""
        if not len(start):
            return np.empty(0, _U), np.empty(0, _U)
        first = self.first or Hashes(self.data, 0)
        return first.of(start, stop), (Hashes(self.data, 1).of(start, stop) >> _U(33)) << _U(1)


def chunks(texts: list[bytes]) -> Iterator[Chunk]:
    pieces, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - THRESHOLD + 1), CHUNK - THRESHOLD):
            piece = text[at:at + CHUNK - 1]
            if len(piece) < THRESHOLD:
                continue
            if size + len(piece) > CHUNK:
                yield Chunk(pieces)
                pieces, size = [], 0
            pieces.append((row, at, piece))
            size += len(piece)
    if pieces:
        yield Chunk(pieces)


# What travels between batches: columns of numbers, as byte planes.

def planes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width:].T).tobytes()


def unplanes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, 8 - width:] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view(">u8").astype(_U)


#: Kinds of entries and the bytes of their columns: anchors with a flag (of several documents), stretches or windows
#: (two parts of the key, flagged if the batch has several documents with it) with their smallest document, anchors
#: with one stretch (both parts of its key, flagged if the batch has several stretches).
ANCHORS, STRETCHES, SEVERAL, WINDOWS = 1, 2, 3, 4
WIDTHS = {ANCHORS: (6, 1), STRETCHES: (8, 4, 8), SEVERAL: (6, 8, 4), WINDOWS: (8, 4, 8)}
#: Of replies. Anchors are cut to 32 bits: one that is taken for another costs a look at some more windows.
TOLD = {ANCHORS: (4,), STRETCHES: (8, 4, 8), SEVERAL: (4,), WINDOWS: (8, 4, 8)}
BATCHES = "batch long, keys binary, null_keys binary, sizes binary, texts binary"
ENTRIES = "bucket int, batch long, kind int, a binary, b binary, c binary"
REPLIES = "batch long, kind int, a binary, b binary, c binary"


def packed(widths: tuple[int, ...], columns: tuple[np.ndarray, ...]) -> list[bytes]:
    blobs = [planes(c, w) for c, w in zip(columns, widths)]
    return blobs + [b""] * (3 - len(blobs))


def frugal(run: Callable) -> Callable:
    """``run``, handing freed memory back after each call."""
    def call(*tables: pa.Table) -> pa.Table:
        made = run(*tables)
        give_back()
        return made

    # Spark tells by the number of parameters what it passes.
    if len(inspect.signature(run).parameters) == 1:
        return lambda table: call(table)
    return lambda documents, replies: call(documents, replies)


def rows_of(table: pa.Table, kind: int, widths: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of all entries of a kind, and the batch of each."""
    names, kinds = ("a", "b", "c"), table.column("kind").to_pylist()
    picked = [i for i, k in enumerate(kinds) if k == kind]
    columns = []
    for name, width in zip(names, widths):
        column = table.column(name)
        parts = [unplanes(column[i].as_py(), width) for i in picked]
        columns.append(np.concatenate(parts) if parts else np.empty(0, _U))
        sizes = [len(p) for p in parts]
    batches = np.repeat(np.array([table.column("batch")[i].as_py() for i in picked], np.int64), sizes)
    return columns, batches


def dealt(kind: int, columns: tuple[np.ndarray, ...], batch: int, buckets: int) -> Iterator[tuple]:
    """Entries sorted by their first column, cut by the bucket that it chooses."""
    top = columns[0] >> _U(8 * WIDTHS[kind][0] - 32)
    edges = np.searchsorted((top * _U(buckets)) >> _U(32), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        part = slice(edges[b], edges[b + 1])
        yield (int(b), batch, kind, *packed(WIDTHS[kind], tuple(c[part] for c in columns)))


def first_of(columns: tuple[np.ndarray, ...]) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def other_than_first(new: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For groups of rows that start at ``new``: is any key (a, b) another than the group's first?"""
    if not len(new):
        return np.zeros(0, bool)
    first = np.repeat(new, np.diff(np.append(new, len(a))))
    return np.logical_or.reduceat((a != a[first]) | (b != b[first]), new)


def least_documents(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key (a, b) once, in order, flagged if it has several documents, with its smallest one."""
    key = b & ~_U(1)
    order = np.lexsort((doc, key, a))
    a, b, doc, key = a[order], b[order], doc[order], key[order]
    new = np.flatnonzero(first_of((a, key)))
    if not len(new):
        return a, b, doc
    last = np.append(new[1:], len(a)) - 1
    several = np.bitwise_or.reduceat(b & _U(1), new) | (doc[new] != doc[last]).astype(_U)
    return a[new], key[new] | several, doc[new]


def look_up(keys: tuple[np.ndarray, ...], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (a, b) the place of that key among sorted, different ``keys``, and whether it is there."""
    if not len(keys[0]):
        return np.zeros(len(a), np.int64), np.zeros(len(a), bool)
    at = np.searchsorted(keys[0], a)
    found = np.zeros(len(a), bool)
    other = keys[1] & ~_U(1)
    # Keys of one first part stand next to each other; more than one is rare.
    for _ in range(len(keys[0])):
        inside = np.minimum(at, len(keys[0]) - 1)
        same = ~found & (at < len(keys[0])) & (keys[0][inside] == a)
        found |= same & (other[inside] == b)
        step = same & ~found
        if not step.any():
            break
        at[step] += 1
    return np.minimum(at, len(keys[0]) - 1), found


def contained(values: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Which values are among sorted members."""
    if not len(members):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(members, values), len(members) - 1)
    return members[at] == values


# The passes. Each function gets one batch of documents, with what earlier passes replied to it.

def gathered(target: int):
    """Texts that are read together as rows of ``BATCHES``, of ``target`` bytes each, about. A batch is numbered by a
    hash of what it holds, so one that is made again after a loss has the same number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        squeeze = zstandard.ZstdCompressor(3).compress
        rows, size = [], 0

        def close() -> pa.RecordBatch:
            texts = squeeze(b"".join(r[2] for r in rows))
            parts = [np.array([r[0] for r in rows], "<i8").tobytes(), np.array([r[1] for r in rows], "u1").tobytes(),
                     np.array([len(r[2]) for r in rows], "<i8").tobytes()]
            number = np.frombuffer(hashlib.blake2b(b"".join([*parts, texts]), digest_size=8).digest(), "<i8")
            return pa.RecordBatch.from_arrays(
                [pa.array(number), *(pa.array([squeeze(x)], pa.binary()) for x in parts), pa.array([texts], pa.binary())],
                names=["batch", "keys", "null_keys", "sizes", "texts"])

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if rows and size + len(row[2]) > target:
                    yield close()
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
        if rows:
            yield close()

    return run


class Batch:
    """Rows of one number (several if tasks have read the same texts), with what earlier passes replied."""

    def __init__(self, documents: pa.Table, replies: pa.Table | None):
        import zstandard
        open_ = zstandard.ZstdDecompressor().decompress
        self.number = documents.column("batch")[0].as_py()
        self.ids, self.null_ids, sizes, whole = (
            b"".join(open_(x) for x in documents.column(c).to_pylist()) for c in ("keys", "null_keys", "sizes", "texts"))
        self.ids = np.frombuffer(self.ids, "<i8")
        self.null_ids = np.frombuffer(self.null_ids, "u1") > 0
        self.keys = self.ids.view(_U) ^ _SIGN  # ordered as unsigned
        ends = np.cumsum(np.frombuffer(sizes, "<i8"))
        self.texts = [whole[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        self.chunks = []
        if replies is not None:
            self.shared = np.sort(rows_of(replies, ANCHORS, TOLD[ANCHORS])[0][0])
        for c in chunks(self.texts):
            if replies is not None:
                self.candidates(c)
            c.first = None  # sums are made anew where they are needed again: they are many times the text
            self.chunks.append(c)
        if replies is not None:
            self.several = np.sort(rows_of(replies, SEVERAL, TOLD[SEVERAL])[0][0])
            self.told = {k: least_documents(*rows_of(replies, k, TOLD[k])[0]) for k in (STRETCHES, WINDOWS)}

    def candidates(self, c: Chunk) -> None:
        """Keep runs whose anchor stands in several documents, and key their stretches."""
        c.pick(contained(c.anchor >> _U(16), self.shared))
        c.a, c.b = c.keys(c.lo, c.hi + (THRESHOLD - 1))
        c.doc = self.keys[c.row]

    def every(self, name: str) -> np.ndarray:
        parts = [getattr(c, name) for c in self.chunks]
        return np.concatenate(parts) if parts else np.empty(0, _U)

    def earlier(self, kind: int, a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which keys have a smaller document than ``doc``. Every key of which that can be so has been replied."""
        at, found = look_up(self.told[kind][:2], a, b)
        return found & (self.told[kind][2][at] < doc) if found.any() else found

    def settle(self) -> None:
        """Part runs into ``gone`` (an earlier document has the stretch) and ``asked`` (windows decide)."""
        for c in self.chunks:
            c.gone = self.earlier(STRETCHES, c.a, c.b, c.doc)
            c.asked = ~c.gone & contained(c.anchor >> _U(16), self.several)

    def windows(self, c: Chunk) -> tuple[np.ndarray, ...]:
        """Run, place and key of each window that is asked for. They are many times the text, so a chunk's are made
        where they are needed and not kept."""
        size = (c.hi - c.lo)[c.asked]
        run = np.repeat(np.flatnonzero(c.asked), size)
        at = c.lo[run] + np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
        return run, at, *c.keys(at, at + THRESHOLD)

    def least_windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each window's key once, flagged if several documents of the batch have it, with the smallest."""
        parts = [(np.empty(0, _U),) * 3]
        for c in self.chunks:
            run, _, a, b = self.windows(c)
            parts.append(least_documents(a, b, c.doc[run]))
        return least_documents(*(np.concatenate(x) for x in zip(*parts)))


def batch_of_entries(rows: list[tuple], schema: str = ENTRIES) -> pa.Table:
    names = [f.split(" ")[0] for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[f.split(" ")[1]] for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def send_anchors(buckets: int):
    def run(documents: pa.Table) -> pa.Table:
        batch = Batch(documents, None)
        anchor, doc = batch.every("anchor"), np.concatenate([batch.keys[c.row] for c in batch.chunks] or [[]])
        order = np.argsort(anchor, kind="stable")
        anchor, doc = anchor[order], doc[order]
        new = np.flatnonzero(first_of((anchor,)))
        other = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & (doc[1:] != doc[:-1])])[:len(anchor)]
        flags = np.logical_or.reduceat(other, new) if len(new) else other
        return batch_of_entries(list(dealt(ANCHORS, (anchor[new], flags.astype(_U)), batch.number, buckets)))
    return run


def send_stretches(buckets: int):
    def run(documents: pa.Table, replies: pa.Table) -> pa.Table:
        if not documents.num_rows:
            return batch_of_entries([])
        batch = Batch(documents, replies)
        a, b, anchor = batch.every("a"), batch.every("b"), batch.every("anchor")
        out = list(dealt(STRETCHES, least_documents(a, b, batch.every("doc")), batch.number, buckets))
        order = np.argsort(anchor, kind="stable")
        a, b, anchor = a[order], b[order], anchor[order]
        new = np.flatnonzero(first_of((anchor,)))
        several = other_than_first(new, a, b).astype(_U)
        out += dealt(SEVERAL, (anchor[new], a[new], b[new] | several), batch.number, buckets)
        return batch_of_entries(out)
    return run


def send_windows(buckets: int):
    def run(documents: pa.Table, replies: pa.Table) -> pa.Table:
        if not documents.num_rows:
            return batch_of_entries([])
        batch = Batch(documents, replies)
        batch.settle()
        return batch_of_entries(list(dealt(WINDOWS, batch.least_windows(), batch.number, buckets)))
    return run


def merge(entries: pa.Table) -> pa.Table:
    """One bucket of entries: what each batch has to know."""
    out = []

    def reply(kind: int, columns: list[np.ndarray], batches: np.ndarray) -> None:
        order = np.argsort(batches, kind="stable")
        batches, columns = batches[order], [c[order] for c in columns]
        edges = np.append(np.flatnonzero(first_of((batches,))), len(batches))
        for x, y in zip(edges[:-1], edges[1:]):
            out.append((int(batches[x]), kind, *packed(TOLD[kind], tuple(c[x:y] for c in columns))))

    for kind in (ANCHORS, SEVERAL):
        (key, *rest), batches = rows_of(entries, kind, WIDTHS[kind])
        if not len(key):
            continue
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(first_of((key[order],)))
        size = np.diff(np.append(new, len(key)))
        rest = [x[order] for x in rest]
        flag = np.logical_or.reduceat(rest[-1] & _U(1) > 0, new)
        # Several batches hold several documents; of stretches both parts decide.
        flag |= size > 1 if kind == ANCHORS else other_than_first(new, rest[0], rest[1] & ~_U(1))
        told = np.zeros(len(key), bool)
        told[order] = np.repeat(flag, size)
        reply(kind, [key[told] >> _U(16)], batches[told])
    for kind in (STRETCHES, WINDOWS):
        (a, b, doc), batches = rows_of(entries, kind, WIDTHS[kind])
        if not len(a):
            continue
        flag, b = b & _U(1), b & ~_U(1)
        order = np.lexsort((doc, b, a))
        new = np.flatnonzero(first_of((a[order], b[order])))
        least = np.empty(len(a), _U)
        least[order] = np.repeat(doc[order][new], np.diff(np.append(new, len(a))))
        told = (doc > least) | (flag > 0)  # the batch has a later document with the key
        reply(kind, [a[told], b[told], least[told]], batches[told])
    return batch_of_entries(out, REPLIES)


def removed_spans(batch: Batch) -> list[list[tuple[int, int]]]:
    """Maximal removed runs of each text."""
    batch.settle()
    found: list[list[tuple[int, int]]] = [[] for _ in batch.texts]
    for c in batch.chunks:
        run, place, a, b = batch.windows(c)
        hit = batch.earlier(WINDOWS, a, b, c.doc[run])
        run, place = run[hit], place[hit]
        row = np.concatenate([c.row[c.gone], c.row[run]])
        shift = np.concatenate([c.shift[c.gone], c.shift[run]])
        start = np.concatenate([c.lo[c.gone], place]) + shift
        stop = np.concatenate([c.hi[c.gone] + (THRESHOLD - 1), place + THRESHOLD]) + shift
        order = np.lexsort((start, row))
        for r, x, y in zip(row[order].tolist(), start[order].tolist(), stop[order].tolist()):
            spans = found[r]
            if spans and x <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(y, spans[-1][1]))
            else:
                spans.append((x, y))
    return found


REMOVED = "key long, null_key boolean, n_bytes long, starts array<long>, stops array<long>, kept binary"


def remove(documents: pa.Table, replies: pa.Table) -> pa.Table:
    longs, names = pa.list_(pa.int64()), [f.split(" ")[0] for f in REMOVED.split(", ")]
    if not documents.num_rows:
        types = [pa.int64(), pa.bool_(), pa.int64(), longs, longs, pa.binary()]
        return pa.table([pa.array([], t) for t in types], names=names)
    batch = Batch(documents, replies)
    spans = removed_spans(batch)
    kept = []
    for text, cut in zip(batch.texts, spans):
        ends = [0, *(y for _, y in cut)]
        kept.append(b"".join(text[e:x] for e, x in zip(ends, [*(x for x, _ in cut), len(text)])))
    return pa.table([
        pa.array(batch.ids), pa.array(batch.null_ids), pa.array(map(len, batch.texts), pa.int64()),
        pa.array([[x for x, _ in s] for s in spans], longs), pa.array([[y for _, y in s] for s in spans], longs),
        pa.array(kept, pa.binary())], names=names)


def without_repeated_windows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes``, ``starts`` and ``stops`` of the removed runs of bytes, and ``kept`` (binary)."""
    spark = df.sparkSession
    ship(spark)
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("key"),
                     F.col(key).isNull().alias("null_key"), body.alias("text"), F.xxhash64(body).alias("h1"),
                     F.xxhash64(F.lit(1), body).alias("h2")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    repeated = written(rows.where(F.col("n_bytes") >= THRESHOLD).groupBy("h1", "h2").agg(
        F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").drop("last"), "copies")
    rows = rows.join(small(repeated, COPIES), ["h1", "h2"], "left")
    whole = (F.col("n_bytes") >= THRESHOLD) & F.coalesce(F.col("first") < F.col("key"), F.lit(False))
    long_ = rows.where((F.col("n_bytes") >= THRESHOLD) & ~whole).select("key", "null_key", "text")
    size = long_.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches, buckets = (max(tasks, math.ceil(size / b)) for b in (BATCH_BYTES, MERGE_BYTES))
    target = min(BATCH_BYTES, max(1 << 16, size // tasks))
    documents = long_.mapInArrow(gathered(target), BATCHES).repartition(batches, "batch")

    def replies(entries: DataFrame) -> DataFrame:
        return entries.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(frugal(merge), REPLIES)

    def ask(told: DataFrame, run) -> DataFrame:
        told = told.repartition(batches, "batch")
        return documents.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(frugal(run), ENTRIES)

    told = replies(documents.groupBy("batch").applyInArrow(frugal(send_anchors(buckets)), ENTRIES))
    told = told.union(replies(ask(told, send_stretches(buckets))))
    told = told.union(replies(ask(told, send_windows(buckets))))
    done = documents.groupBy("batch").cogroup(told.repartition(batches, "batch").groupBy("batch")).applyInArrow(
        frugal(remove), REMOVED)
    # Copies are one removed run; short texts have none.
    ends = [F.when(whole, F.array(c.cast("long"))).otherwise(F.expr("cast(array() AS array<long>)"))
            for c in (F.lit(0), F.col("n_bytes"))]
    rest = rows.where((F.col("n_bytes") < THRESHOLD) | whole).select(
        "key", "null_key", "n_bytes", ends[0].alias("starts"), ends[1].alias("stops"),
        F.when(whole, F.lit(b"")).otherwise(F.col("text")).alias("kept"))
    return done.union(rest).select(F.when(~F.col("null_key"), F.col("key")).alias(key), "n_bytes", "starts", "stops", "kept")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    removed = F.aggregate(F.zip_with("starts", "stops", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(key, "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))
