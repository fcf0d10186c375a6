"""Canonical length-limited Huffman codes on arrays: code lengths, packing, table-driven decoding."""

from __future__ import annotations

import numpy as np

LIMIT = 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits by package-merge; 0 for ids without a count."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    weights, flags = leaves, [np.ones(len(leaves), dtype=bool)]
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, pairs])
        at = np.argsort(merged, kind="stable")
        weights = merged[at]
        flags.append(at < len(leaves))
    take = 2 * len(leaves) - 2
    for flag in reversed(flags):
        n = int(flag[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


class Code:
    """The canonical code of some lengths: shorter codes first, ids ascending among equal lengths."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths.astype(np.uint8)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        bits = lengths[order].astype(np.int64)
        self.longest = int(bits[-1]) if len(bits) else 1
        steps = 1 << (self.longest - bits)
        first = np.concatenate([[0], np.cumsum(steps)[:-1]]) if len(bits) else np.zeros(0, dtype=np.int64)
        self.codes = np.zeros(len(lengths), dtype=np.uint32)
        self.codes[order] = (first >> (self.longest - bits)).astype(np.uint32)
        self.table = np.ones(1 << self.longest, dtype=np.int64)  # an id and its bits
        self.table[: int(steps.sum())] = np.repeat(order << 5 | bits, steps)

    def encode(self, ids: np.ndarray, stride: int) -> tuple[bytes, np.ndarray]:
        """The bits, first bit highest, and the bit offset of every stride-th id; the stride is a multiple of 4."""
        if not len(ids):
            return b"", np.zeros(0, dtype=np.uint64)
        pad = -len(ids) % 4
        code, bits = (np.append(x[ids], np.zeros(pad, dtype=x.dtype)) for x in (self.codes, self.lengths))
        for _ in range(2):  # codes of 16 bits at most: four fit a word
            code = (code[::2].astype(np.uint64) << bits[1::2].astype(np.uint64)) | code[1::2]
            bits = bits[::2] + bits[1::2]
        bits = bits.astype(np.int64)
        ends = np.cumsum(bits)
        begins = ends - bits
        word, shift = begins >> 6, 64 - (begins & 63) - bits
        over = np.flatnonzero(shift < 0)
        high = code << np.maximum(shift, 0).astype(np.uint64)
        high[over] = code[over] >> (-shift[over]).astype(np.uint64)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        words = np.zeros(int((ends[-1] + 63) >> 6) + 1, dtype=np.uint64)
        words[word[starts]] = np.add.reduceat(high, starts)
        words[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
        return words.astype(">u8").tobytes()[: int(ends[-1] + 7) >> 3], begins[:: stride // 4].astype(np.uint64)

    def decode(self, data: bytes, count: int, offsets: np.ndarray, stride: int) -> np.ndarray:
        """All ids of a block: the runs between checkpoints are read side by side, one table lookup an id."""
        if not count:
            return np.zeros(0, dtype=np.uint32)
        raw = np.frombuffer(bytes(data) + b"\0" * 8, dtype=np.uint8)
        window = np.ndarray(len(raw) - 3, dtype=">u4", buffer=raw, strides=(1,)).astype(np.int64)  # the four bytes from each byte on
        out = np.zeros((min(stride, count), len(offsets)), dtype=np.int64)
        at, mask, left = offsets.astype(np.int64), (1 << self.longest) - 1, 32 - self.longest
        last = (len(window) - 1) << 3
        for row in out:
            key = window.take(at >> 3)
            key >>= left - (at & 7)
            key &= mask
            self.table.take(key, out=row, mode="clip")
            at += row & 31
            if at[-1] > last:  # only the last run may be shorter
                at[-1] = last
        out >>= 5
        return out.T.reshape(-1)[:count].astype(np.uint32)
