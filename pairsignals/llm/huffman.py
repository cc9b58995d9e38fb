"""Canonical, length-limited Huffman codes over ids, with numpy.

Codes are at most ``LIMIT`` bits long, so one table look-up of ``LIMIT`` bits
gives an id and the length of its code. A decoder starts at any checkpoint;
many checkpoints are decoded side by side, one id of each per step.
"""

from __future__ import annotations

import numpy as np

#: Longest code in bits; 2 ** LIMIT ids at most can have a code.
LIMIT = 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for
    an id that does not occur."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order]
    # Each level lists leaves and packages (pairs of the level below) by weight.
    levels, weights = [], np.empty(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([leaves, weights])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(leaves))
        both = both[by]
        weights = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    # 2n - 2 items are taken from the last level, and for each package taken
    # two items of the level below. Leaves are taken lightest first.
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


class Code:
    """Codes in canonical order: by length, then by id."""

    def __init__(self, lengths: np.ndarray, limit: int = LIMIT):
        self.limit, self.lengths = limit, np.asarray(lengths, np.uint8)
        ids = np.flatnonzero(self.lengths)
        ids = ids[np.argsort(self.lengths[ids], kind="stable")]
        sizes = self.lengths[ids].astype(np.int64)
        span = np.left_shift(1, limit - sizes)  # table cells of each code
        first = np.cumsum(span) - span
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[ids] = first >> (limit - sizes)
        used = int(span.sum())
        self.symbol = np.zeros(1 << limit, np.uint32)
        self.size = np.ones(1 << limit, np.uint8)
        self.symbol[:used] = np.repeat(ids, span)
        self.size[:used] = np.repeat(sizes, span)

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bit streams of consecutive runs of ``counts`` ids each.

        Returns all bytes, the first byte of each run (with the end of the
        last), and the bit offset of each id in its run. Each run starts on a
        byte.
        """
        counts = np.asarray(counts, np.int64)
        size = self.lengths[ids].astype(np.int64)
        if len(ids) and not size.min():
            raise ValueError("an id without a code")
        end = np.concatenate([[0], np.cumsum(size)])
        edge = np.concatenate([[0], np.cumsum(counts)])
        bits = end[edge]
        bytes_at = np.concatenate([[0], np.cumsum((np.diff(bits) + 7) // 8)])
        within = end[:-1] - np.repeat(bits[:-1], counts)
        at = within + np.repeat(bytes_at[:-1] * 8, counts)
        # A code lies in one 32-bit word or in two; no two codes share a bit,
        # so sums of the parts in a word put them together.
        word, shift = at >> 5, (64 - size - (at & 31)).astype(np.uint64)
        both = self.codes[ids] << shift
        n = int(bytes_at[-1] + 3) // 4 + 1
        made = np.bincount(word, (both >> np.uint64(32)).astype(np.float64), n)
        made += np.bincount(word + 1, (both & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[:n]
        data = made.astype(np.uint32).astype(">u4").view(np.uint8)[: bytes_at[-1]]
        return data, bytes_at, within

    def decode(self, data: np.ndarray, bit: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of the runs that start at bits ``bit`` of ``data`` and hold
        ``counts`` ids each, one after the other."""
        counts = np.asarray(counts, np.int64)
        out = np.zeros(int(counts.sum()), np.uint32)
        if not len(out):
            return out
        # 32 bits from every byte on: enough for a code at any of its bits.
        d = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
        window = (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]
        to = np.cumsum(counts) - counts
        by = np.argsort(-counts, kind="stable")  # the longest first, so the lanes in use stay in front
        bit, to = np.asarray(bit, np.int64)[by], to[by]
        busy = np.searchsorted(-counts[by], -np.arange(counts.max()), side="left")
        drop = 32 - self.limit
        for step, n in enumerate(busy.tolist()):
            b = bit[:n]
            cell = ((window[b >> 3] << (b & 7).astype(np.uint32)) >> np.uint32(drop))
            out[to[:n] + step] = self.symbol[cell]
            b += self.size[cell]
        return out
