"""Byte-level BPE encoding and decoding.

The ``tokenizers`` library holds the merges; a byte-to-character table maps
the bytes of a piece to the characters its model works on. Texts come in
Arrow batches, are cut into the matches of the split pattern, and the ids of a
recurring stretch of text are looked up instead of being merged again.
Decoding reverses the byte table, so an id that holds part of a character
gives back just its bytes.

A NULL text has no ids; neither has an empty one.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import models

from pairsignals.llm.common import map_arrow, slices

#: Words and pieces a worker remembers before it starts afresh; bounds its memory only.
WORDS, PIECES = 500_000, 800_000


def byte_characters() -> list[str]:
    """One printable character for each byte: printable Latin-1 stands for
    itself, the others take the characters from U+0100 on."""
    out, spare = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Memo(dict):
    """Remembers what ``make`` returned, and starts afresh when full."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encoder and decoder for a file of base64 tokens and ranks.

    A pair of tokens may merge if its concatenation is a token, the lowest
    rank first. The model takes a list of pairs, so every way to cut a token
    into two tokens is listed, ordered by the rank of the whole.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        chars = byte_characters()
        self.table = {b: chars[b] for b in range(256)}
        name = {token: "".join([chars[b] for b in token]) for token in ranks}
        merges = [(name[token[:i]], name[token[i:]])
                  for token in sorted(ranks, key=ranks.__getitem__)
                  for i in range(1, len(token))
                  if token[:i] in ranks and token[i:] in ranks]
        self.model = models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            self.tokens[r] = token
        self.split = regex.compile(pattern).findall
        self.pieces = Memo(self._merged, PIECES)
        self.words = Memo(self._word, WORDS)

    def _merged(self, piece: str) -> bytes:
        """Ids of one match, as little-endian unsigned 32-bit integers."""
        merged = self.model.tokenize(piece.encode().decode("latin-1").translate(self.table))
        return struct.pack(f"<{len(merged)}I", *[t.id for t in merged])

    def _ids(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def _word(self, word: str) -> bytes:
        """Ids of a word with the single space before it, or with the line
        end before it where that is its first character."""
        if word.isalpha():
            return self.pieces[" " + word]
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return self.pieces[" " + word[:-1]] + self.pieces[word[-1]]
        return self._ids(word if word[0] == "\n" else " " + word)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text.

        Where single spaces and line ends are the only white space, each
        between two words, no match of the pattern crosses from one word to
        the next (a space belongs to the word behind it, a line end stands
        alone), so the text is encoded word by word. Any other text goes
        through the pattern as a whole.
        """
        if not text:
            return b""
        if text.replace("\n", " ").split(" ") != text.split():
            return self._ids(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return b"".join([self._ids(first), *map(self.words.__getitem__, rest)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> tuple[list[int], list[int]]:
        """First and last-plus-one character of each id. An id that ends or
        starts inside a character counts the whole character."""
        parts = [self.tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]
        data = np.frombuffer(b"".join(parts), "u1")
        starts = np.cumsum((data & 0xC0) != 0x80)  # characters begun up to each byte
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        begins = ends - np.array([len(p) for p in parts], np.int64)
        return (starts[begins] - 1).tolist(), starts[ends - 1].tolist()


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(df: DataFrame, vocabulary: str, pattern: str = public_tokenizers.PATTERN, key: str = "doc_id",
                     text: str = "text", with_offsets: bool = False) -> DataFrame:
    """``key``, ``ids`` (binary: little-endian unsigned 32-bit integers),
    ``decoded`` (binary: the bytes those ids stand for) and, if asked for,
    ``starts`` and ``ends`` (characters of each id).

    ``vocabulary`` is a path that every executor can read.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, ids binary, decoded binary"
    schema += ", starts array<int>, ends array<int>" if with_offsets else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for part in slices(batches):
            ids = [c.encode(t) if t else b"" for t in part.column(1).to_pylist()]
            arrays = [part.column(0), pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.binary())]
            names = [key, "ids", "decoded"]
            if with_offsets:
                spans = [c.offsets(i) if i else ([], []) for i in ids]
                arrays += [pa.array([s[j] for s in spans], pa.list_(pa.int32())) for j in (0, 1)]
                names += ["starts", "ends"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return map_arrow(df.select(F.col(key), F.col(text).cast("string").alias("__text")), run, schema)


def digests(encoded: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Number of ids and the SHA-256 of ids and decoded bytes."""
    return encoded.select(
        key, *keep, F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
