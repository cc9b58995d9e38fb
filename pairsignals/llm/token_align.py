"""Alignment of the tokens of two tokenizers.

Both token sequences of a text cover the same bytes. Where a token of one and
a token of the other end at the same byte, both sequences are cut; every pair
of tokens between two cuts is a link. The cuts are the common keys of two
dictionaries from cumulative ends to token numbers.

Neither tokenizer has a token over certain places (before a single space or
line end between two words, and between letters and the marks ``.,;:!?``
behind them), so both sequences end there. A text is cut into units at these
places first, and a recurring unit is aligned once and remembered. Which marks
may be cut off is read from the vocabularies.

Documents are handled in chunks. A chunk lists the pairs of ids it holds once,
with the number of its documents that hold each; its documents point into that
list. Only these lists are shuffled to count the documents of each pair, and
the counts come back to the chunk that asks for them, so neither the ids of
documents nor their pairs are ever exploded, and a pair that every document
holds is one row of each chunk.

Rows: NULL and empty texts, and texts that the second tokenizer alters (it
turns U+2581 into a space), have no tokens: zeros and an empty digest. Rows
that repeat a key are documents of their own. An empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairsignals.llm.byte_bpe import byte_characters
from pairsignals.llm.common import map_arrow, ship, slices, written

#: Units a worker remembers, and their characters, before it starts afresh; bounds its memory only.
UNITS, UNIT_CHARS = 500_000, 16_000_000
#: Documents and characters after which a chunk is closed; a longer text has a chunk of its own.
CHUNK_ROWS, CHUNK_CHARS = 4096, 4_000_000
#: Units encoded at once, characters of them at once.
ENCODED, ENCODED_CHARS = 8192, 1_000_000
SPACE = "▁"
MARKS = ".,;:!?"
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def groups(ends_a: Iterable[int], ends_b: Iterable[int]) -> list[tuple[int, int, int, int]]:
    """Slices (first and last-plus-one token of each sequence) between the
    ends that both sequences have. Ends ascend; tokens of no bytes belong to
    the group they end in."""
    at_a = {e: i for i, e in enumerate(ends_a, 1)}
    at_b = {e: i for i, e in enumerate(ends_b, 1)}
    out, a, b = [], 0, 0
    for e in sorted(at_a.keys() & at_b.keys()):
        out.append((a, at_a[e], b, at_b[e]))
        a, b = at_a[e], at_b[e]
    return out


class Pair:
    """Both tokenizers, and the units aligned so far."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = {c: i for i, c in enumerate(byte_characters())}
        size = max(self.a.get_vocab().values(), default=-1) + 1
        self.bytes_a = [b""] * size
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes(back[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(pieces)]
        self.before = len(self.b.encode("\n", num_threads=1))
        # Cuts hold if no piece runs over them; the first tokenizer's split pattern cuts at all of them.
        own = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.words = not any("\n" in p or SPACE in p.lstrip(SPACE) for p in own)
        self.marks = frozenset(m for m in MARKS if not any(m in p[1:] and p[0].isalpha() for p in (
            p.lstrip(SPACE) for p in own) if p))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        # Of each unit: tokens, groups, links (-1 tokens: altered), the text of its groups, its pairs and their links.
        self.n_a, self.n_b, self.n_groups, self.n_links, self.n_pairs = (array("q") for _ in range(5))
        self.text: list[bytes] = []
        self.pairs, self.times = array("q"), array("q")
        self.pair_number: dict[int, int] = {}

    def units(self, text: str) -> list[str]:
        """The text, with a space before it, in units that join up to it."""
        if not self.words:
            return [" " + text]
        if text.replace("\n", " ").split(" ") != text.split():
            found = CUT.split(" " + text)
        else:
            # Each word with the space or the line end before it.
            found = (" " + text.replace("\n", " \n")).split(" ")[1:]
            found = [w if w[0] == "\n" else " " + w for w in found]
        out = []
        for w in found:
            if w[-1] in self.marks and w[1:-1].isalpha():
                out += (w[:-1], w[-1])
            else:
                out.append(w)
        return out

    def numbers(self, units: list[str]) -> list[int]:
        """The number of each unit; those that are new are aligned first."""
        found = list(map(self.number.get, units))
        if None not in found:
            return found
        new = list({u: None for u, i in zip(units, found) if i is None})
        at = 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and end - at < ENCODED and (end == at or size + len(new[end]) <= ENCODED_CHARS):
                size += len(new[end])
                end += 1
            some = new[at:end]
            found_a = self.a.encode_batch_fast(some, add_special_tokens=False)
            # The second tokenizer adds a space of its own. No token runs over a line end, so a unit
            # without a space stands behind one, and the tokens before it are taken off again.
            found_b = self.b.encode([u[1:] if u[0] == " " else "\n" + u for u in some], num_threads=1)
            for u, a, b in zip(some, found_a, found_b):
                self.number[u] = len(self.text)
                self.chars += len(u)
                self._align(u, a.ids, b if u[0] == " " else b[self.before:])
            at = end
        return list(map(self.number.get, units))

    def _align(self, unit: str, a: list[int], b: list[int]) -> None:
        parts_a, parts_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        data = unit.encode()
        links: dict[int, int] = {}
        if b"".join(parts_a) != data or b"".join(parts_b) != data:
            self._keep(-1, 0, [], b"", links, 0)
            return
        if len(a) == 1 or len(b) == 1:
            cut = [(0, len(a), 0, len(b))]
        else:
            cut = groups(accumulate(map(len, parts_a)), accumulate(map(len, parts_b)))
        texts, n = [], 0
        for a0, a1, b0, b1 in cut:
            n += (a1 - a0) * (b1 - b0)
            if a1 - a0 == b1 - b0 == 1:
                texts.append(f"{a[a0]}|{b[b0]}")
                code = a[a0] << 32 | b[b0]
                links[code] = links.get(code, 0) + 1
                continue
            some, others = a[a0:a1], b[b0:b1]
            texts.append(f"{','.join(map(str, some))}|{','.join(map(str, others))}")
            for code, times in _products(some, others):
                links[code] = links.get(code, 0) + times
        self._keep(len(a), len(b), cut, ";".join(texts).encode(), links, n)

    def _keep(self, n_a: int, n_b: int, cut: list, text: bytes, links: dict[int, int], n: int) -> None:
        self.n_a.append(n_a)
        self.n_b.append(n_b)
        self.n_groups.append(len(cut))
        self.n_links.append(n)
        self.n_pairs.append(len(links))
        self.text.append(text)
        number = self.pair_number
        self.pairs.extend([number.setdefault(c, len(number)) for c in links])
        self.times.extend(links.values())


def _products(some: list[int], others: list[int]) -> Iterator[tuple[int, int]]:
    """Links of a group by pair of ids, with their number."""
    a, b = {}, {}
    for i in some:
        a[i] = a.get(i, 0) + 1
    for i in others:
        b[i] = b.get(i, 0) + 1
    for i, n in a.items():
        for j, m in b.items():
            yield i << 32 | j, n * m


@lru_cache(maxsize=1)
def tokenizers_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


DOCUMENTS = ("key", "n_a", "n_b", "n_groups", "n_links")
CHUNK = ("chunk long, keys array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
         "groups array<string>, pairs array<long>, documents array<int>, held array<long>, at binary, times binary")


def aligned_chunk(both: Pair, chunk: int, keys: list, texts: list[str | None]) -> pa.RecordBatch:
    """One chunk's row: counts and digests of its documents, the pairs of ids
    it holds (``pairs``, ascending, in ``documents`` of its documents), and for
    each document ``held`` of them: ``at`` their numbers, ``times`` its links."""
    if len(both.number) > UNITS or both.chars > UNIT_CHARS:
        both.clear()
    sizes, units = [], []
    for t in texts:
        before = len(units)
        if t:
            units += both.units(t)
        sizes.append(len(units) - before)
    number, sizes = np.array(both.numbers(units), np.int64), np.array(sizes, np.int64)
    del units
    docs = np.repeat(np.arange(len(keys)), sizes)
    n_a = np.array(both.n_a, np.int64)
    # A text with a unit that the second tokenizer alters has no tokens.
    bad = np.bincount(docs[n_a[number] < 0], minlength=len(keys)) > 0
    good = ~bad[docs]
    digests, at = [], 0
    for size, wrong in zip(sizes.tolist(), bad.tolist()):
        own = number[at:at + size].tolist()
        at += size
        digests.append("" if wrong or not size else hashlib.sha256(
            b";".join([both.text[i] for i in own])).hexdigest())
    number, docs = number[good], docs[good]

    def total(values: array) -> pa.Array:
        return pa.array([np.bincount(docs, np.array(values, np.int64)[number], len(keys)).astype(np.int64)],
                        pa.list_(pa.int64()))

    totals = [total(v) for v in (both.n_a, both.n_b, both.n_groups, both.n_links)]
    # Units of each document, then pairs of each document, both once with their number.
    of, times = np.unique(docs << 32 | number, return_counts=True)
    docs, number = of >> 32, of & 0xFFFFFFFF
    lengths, flat, each = (np.array(x, np.int64) for x in (both.n_pairs, both.pairs, both.times))
    starts = np.cumsum(lengths) - lengths
    many = lengths[number]
    place = np.repeat(starts[number] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    held = np.repeat(docs, many) << 32 | flat[place]
    links = each[place] * np.repeat(times, many)
    order = np.argsort(held, kind="stable")
    held, links = held[order], links[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.empty(0, np.int64)
    links = np.add.reduceat(links, first) if len(held) else links
    held = held[first]
    docs, used = held >> 32, held & 0xFFFFFFFF
    # Pairs of this chunk, in ascending order of their code.
    names, documents = np.unique(used, return_counts=True)
    codes = np.fromiter(both.pair_number, np.int64, len(both.pair_number))[names]
    order = np.argsort(codes)
    rank = np.empty(len(codes), np.int64)
    rank[order] = np.arange(len(codes))
    return pa.RecordBatch.from_arrays([
        pa.array([chunk], pa.int64()), pa.array([keys], pa.list_(pa.int64())),
        *totals,
        pa.array([digests], pa.list_(pa.string())),
        pa.array([codes[order]], pa.list_(pa.int64())), pa.array([documents[order].astype(np.int32)], pa.list_(pa.int32())),
        pa.array([np.bincount(docs, minlength=len(keys))], pa.list_(pa.int64())),
        pa.array([rank[np.searchsorted(names, used)].astype("<u4").tobytes()], pa.binary()),
        pa.array([links.astype("<u8" if len(links) and links.max() >> 32 else "<u4").tobytes()], pa.binary()),
    ], names=[f.split()[0] for f in CHUNK.split(", ")])


def aligned_chunks(df: DataFrame, path_a: str, path_b: str, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        both, chunk = tokenizers_of(path_a, path_b), TaskContext.get().partitionId() << 32
        keys, texts, size = [], [], 0
        for part in slices(batches):
            for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if keys and (len(keys) >= CHUNK_ROWS or size + len(t or "") > CHUNK_CHARS):
                    yield aligned_chunk(both, chunk, keys, texts)
                    chunk, keys, texts, size = chunk + 1, [], [], 0
                keys.append(k)
                texts.append(t)
                size += len(t or "")
        if keys:
            yield aligned_chunk(both, chunk, keys, texts)

    return map_arrow(df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")), run, CHUNK)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``pair`` (first id and second id in 32 bits each), in how many documents
    it is linked (``n``), and whether none of its first id's pairs is linked in
    more (``best``)."""
    found = chunks.select(F.explode(F.arrays_zip("pairs", "documents")).alias("x"))
    counts = found.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.documents").alias("n"))
    counts = written(counts, "align-counts")
    first = F.shiftright("pair", 32)
    most = counts.groupBy(first.alias("__first")).agg(F.max("n").alias("__most"))
    return counts.join(most, first == F.col("__first")).select("pair", "n", (F.col("n") == F.col("__most")).alias("best"))


RESULT = {"key": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "n_best": "long",
          "count_sum": "long", "groups_sha256": "string"}


def scored(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents with the sums over their links of the pairs' counts."""
    asked = chunks.select(F.col("chunk").alias("asking"), F.explode("pairs").alias("pair")).join(counts, "pair")
    kinds = {"long": pa.int64(), "string": pa.string()}

    def sums(here: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found["pair"].to_numpy())
        n, best = found["n"].to_numpy()[order], found["best"].to_numpy(zero_copy_only=False)[order]
        out: dict[str, list] = {c: [] for c in RESULT}
        for row in here.to_pylist():
            at, held = np.frombuffer(row["at"], "<u4"), np.array(row["held"], np.int64)
            times = np.frombuffer(row["times"], "<u8" if len(row["times"]) == 8 * len(at) else "<u4").astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(held)])
            for c, weight in (("count_sum", n), ("n_best", best)):
                whole = np.concatenate([[0], np.cumsum(times * weight[at] if len(at) else times)])
                out[c] += np.diff(whole[ends]).tolist()
            for c in ("n_a", "n_b", "n_groups", "n_links"):
                out[c] += row[c]
            out["key"] += row["keys"]
            out["groups_sha256"] += row["groups"]
        return pa.table([pa.array(v, kinds[RESULT[c]]) for c, v in out.items()], names=list(RESULT))

    ship(chunks.sparkSession)
    return chunks.drop("pairs", "documents").groupBy("chunk").cogroup(asked.groupBy("asking")).applyInArrow(
        sums, ", ".join(f"{c} {t}" for c, t in RESULT.items()))


def align(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every row: ``key``, numbers of tokens, groups and links, how many of
    its links are their first id's most frequent (``n_best``), the sum of its
    links' counts, and a digest of its groups."""
    chunks = written(aligned_chunks(df, path_a, path_b, key, text), "align", compression="zstd")
    return scored(chunks, pair_counts(chunks)).withColumnRenamed("key", key)
