"""Files of token ids, packed with a canonical Huffman code.

Texts are encoded with the ``tokenizers`` library, ids are counted over the
whole corpus, and every document's ids (its end id last) are packed with one
length-limited canonical code. Documents lie in ascending order of their key.
The files hold independent blocks; a block lists its documents and the bit
offsets of checkpoints, from each of which decoding can begin.

File format, written by Spark as Parquet so that any file store serves:

* ``blocks``: ``part`` and ``block`` (together the order), ``before`` (ids of
  the part's earlier blocks), ``keys`` and ``counts`` (key and number of ids
  of each document), ``checkpoints`` (bit
  offset of every ``STRIDE``-th id of each document, from the block's first
  bit), ``payload`` (the bits). Each document starts on a byte.
* ``code``: ``id`` and ``length`` of each code, from which the code follows.

NULL and empty texts have only the end id. NULL keys come first. Documents
that share a key stand next to each other, ordered by their ids. An empty table gives
no blocks.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairsignals.llm.byte_bpe import PIECES, WORDS, Memo, byte_characters
from pairsignals.llm.common import map_arrow, slices, written
from pairsignals.llm.huffman import Code, code_lengths
from pairsignals.session import scratch_path

#: Ids between two checkpoints of a document.
STRIDE = 256
#: Ids after which a block is closed; a longer document has a block of its own.
BLOCK_IDS = 1 << 18


class Encoder:
    """Ids by a tokenizer file whose normaliser lower-cases and drops white
    space, and whose pieces never hold white space.

    Words (between white space) are then encoded one at a time and
    remembered. For a word of plain characters, which that normaliser only
    lower-cases, the pieces go to the merge model directly; any other word
    goes through the whole tokenizer.
    """

    #: Characters below this are single code points under composition, and lower-case one by one.
    PLAIN = "ɐ"
    #: The tokenizer file's own split pattern (fixed value).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, end_id: int):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Letters are looked up at once only in a tokenizer of this kind.
        self.known = self.PATTERN.replace("\\", "\\\\") in open(path, encoding="utf-8").read()
        self.kind = np.dtype("<u2") if max(end_id, self.tokenizer.get_vocab_size()) < 1 << 16 else np.dtype("<u4")
        self.letter = {2: "H", 4: "I"}[self.kind.itemsize]
        self.end = np.array([end_id], self.kind).tobytes()
        chars = byte_characters()
        self.table = {b: chars[b] for b in range(256)}
        self.split = regex.compile(self.PATTERN).findall
        self.words, self.pieces = Memo(self._word, WORDS), Memo(self._piece, PIECES)

    def _ids(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def _piece(self, piece: str) -> bytes:
        return self._ids([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.table))])

    def _word(self, word: str) -> bytes:
        if not self.known or max(word) >= self.PLAIN or "<" in word:  # special tokens begin with <
            return self._ids(self.tokenizer.encode(word, add_special_tokens=False).ids)
        low = word.lower()
        if low.isalpha():
            return self.pieces[low]
        if low[-1] in ".,;:!?" and low[:-1].isalpha():
            return self.pieces[low[:-1]] + self.pieces[low[-1]]
        return b"".join(map(self.pieces.__getitem__, self.split(low)))

    def encode(self, text: str) -> bytes:
        """Ids of the whole text and the end id."""
        if not UNUSUAL(text):  # fewer spellings to remember; other texts are lower-cased by the tokenizer
            text = text.lower()
        # str.split also splits at four control characters that are not white space here.
        words = text.split() if not CONTROL(text) else re.split(r"[ \t\n\r]+", text.strip(" \t\n\r"))
        return b"".join([*map(self.words.__getitem__, filter(None, words)), self.end])


CONTROL = re.compile("[\x1c-\x1f]").search
UNUSUAL = re.compile("[^\x00-\u024f]").search


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def encode_ids(df: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (binary) of every document, the end id last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary, end_id)
        for part in slices(batches):
            ids = [e.encode(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["key", "ids"])

    return map_arrow(df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string")), run,
                     "key long, ids binary")


def id_counts(encoded: DataFrame, kind: str) -> DataFrame:
    """How often each id occurs: one row for each id and task, then summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(joined(batch.column(0), kind)[0], minlength=len(total))
            found[: len(total)] += total
            total = found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids], pa.int64())],
                                         names=["id", "n"])

    return map_arrow(encoded.select("ids"), run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def joined(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch and how many each row has."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind), np.array([len(v) for v in values], np.int64) // np.dtype(kind).itemsize


def write_token_files(df: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text",
                      path: str | None = None) -> str:
    """Encode ``df`` and write the files; returns their folder.

    The corpus is encoded once, into a table in the shared folder. The id
    counts that reach the driver are bounded by the vocabulary.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "token_files")
    kind = encoder(vocabulary, end_id).kind.str
    encoded = written(encode_ids(df, vocabulary, end_id, key, text), "ids", compression="zstd")
    counts = {r.id: r.n for r in id_counts(encoded, kind).collect()}
    dense = np.zeros(max(counts, default=0) + 1, np.int64)
    dense[list(counts)] = list(counts.values())
    lengths = code_lengths(dense)
    rows = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(rows, "id int, length int").coalesce(1).write.parquet(f"{path}/code")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = packed_documents(encoded, lengths, kind, key_bounds(encoded, n))
    ordered = packed.repartitionById(n, F.col("part")).drop("part").sortWithinPartitions(
        F.col("key").asc_nulls_first(), "n", "bits")
    blocks_of(ordered).write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def key_bounds(encoded: DataFrame, n: int) -> np.ndarray:
    """Keys that deal the documents into ``n`` ranges of about equal numbers,
    from a sketch of the key column alone: documents are packed once, when
    their range is known."""
    found = encoded.approxQuantile("key", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    return np.array([int(x) for x in found], np.int64)


def packed_documents(encoded: DataFrame, lengths: np.ndarray, kind: str, bounds: np.ndarray) -> DataFrame:
    """The bit stream of each document, the bit offset of every
    ``STRIDE``-th id, and the range (``part``) that its key lies in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for part in slices(batches, 1024):
            ids, counts = joined(part.column(1), kind)
            data, at, within = code.encode(ids, counts)
            raw, first = data.tobytes(), np.cumsum(counts) - counts
            marks = [within[f:f + c:STRIDE].astype("<u8").tobytes() for f, c in zip(first, counts)]
            keys = part.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            dealt = np.where(part.column(0).is_null().to_numpy(zero_copy_only=False), 0,
                             np.searchsorted(bounds, keys, side="right"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(dealt, pa.int32()), part.column(0), pa.array(counts, pa.int64()), pa.array(marks, pa.binary()),
                 pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary())],
                names=["part", "key", "n", "marks", "bits"])

    return map_arrow(encoded, run, "part int, key long, n long, marks binary, bits binary")


def blocks_of(ordered: DataFrame) -> DataFrame:
    """Group the sorted documents of each partition into blocks."""
    schema = "part int, block int, before long, keys array<long>, counts array<long>, checkpoints binary, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, number, before, rows, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def close():
            at, marks = 0, []
            for _, _, m, b in rows:
                marks.append(np.frombuffer(m, "<u8") + np.uint64(8 * at))
                at += len(b)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()),
                 pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
                 pa.array([[r[1] for r in rows]], pa.list_(pa.int64())),
                 pa.array([np.concatenate(marks).tobytes()], pa.binary()),
                 pa.array([b"".join(r[3] for r in rows)], pa.binary())],
                names=["part", "block", "before", "keys", "counts", "checkpoints", "payload"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and size + row[1] > BLOCK_IDS:
                    yield close()
                    number, before, rows, size = number + 1, before + size, [], 0
                rows.append(row)
                size += row[1]
        if rows:
            yield close()

    return map_arrow(ordered, run, schema)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files: ``key``, ``start`` (ids of all documents before),
    ``n_tokens`` and ``ids`` (binary: little-endian unsigned 32-bit)."""
    rows = spark.read.schema("id int, length int").parquet(f"{path}/code").collect()  # bounded by the vocabulary
    lengths = np.zeros(max((r.id for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        lengths[r.id] = r.length
    blocks = spark.read.schema("part int, before long, keys array<long>, counts array<long>, checkpoints binary, "
                               "payload binary").parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                part, before, keys, counts, marks, payload = (c[i].as_py() for c in batch.columns)
                counts = np.array(counts, np.int64)
                runs = (counts + STRIDE - 1) // STRIDE
                length = np.full(int(runs.sum()), STRIDE, np.int64)
                length[np.cumsum(runs) - 1] = counts - (runs - 1) * STRIDE
                ids = code.decode(np.frombuffer(payload, np.uint8), np.frombuffer(marks, "<u8"), length)
                raw, end = ids.astype("<u4").tobytes(), np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.int64()),
                     pa.array(before + end - counts, pa.int64()), pa.array(counts, pa.int64()),
                     pa.array([raw[4 * (e - c):4 * e] for e, c in zip(end.tolist(), counts.tolist())], pa.binary())],
                    names=["part", "key", "in_part", "n_tokens", "ids"])

    documents = map_arrow(blocks, run, "part int, key long, in_part long, n_tokens long, ids binary")
    # One row for each task that wrote blocks, whatever the corpus holds: small enough for one window and a broadcast.
    block_ids = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = blocks.groupBy("part").agg(F.sum(block_ids).alias("n")).select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("parts_before"))
    return documents.join(F.broadcast(parts), "part").select(
        "key", (F.col("parts_before") + F.col("in_part")).alias("start"), "n_tokens", "ids")
