"""Many texts at once as flat arrays of bytes and words, for vectorised features and hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ODD = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(77)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0xA0761D6478BD642F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, n at least; kept by size."""
    bits = max(20, n.bit_length())
    if bits not in _powers:
        up, down = np.full(1 << bits, BASE, np.uint64), np.full(1 << bits, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        if bits > 20:  # a very long text's table isn't kept
            return np.multiply.accumulate(up), np.multiply.accumulate(down)
        _powers[bits] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[bits]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Give freed memory back to the system at a task's end: workers live on, several to an executor, and allocators keep what they once had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


class Block:
    """Texts end to end, each followed by a line feed, as UTF-8, with their words.

    ``words`` are maximal runs of bytes other than space, \\t, \\n, \\v, \\f and \\r.
    """

    def __init__(self, coded: list[bytes]):
        self.texts = len(coded)
        self.bytes = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
        size = np.fromiter(map(len, coded), np.int64, len(coded)) + 1
        self.ends = np.cumsum(size)
        self.begins = self.ends - size
        gap = SPACE[self.bytes]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(gap) and not gap[0]:
            edge = np.r_[0, edge]
        self.word_at, self.word_end = edge[0::2], edge[1::2]
        self.word_text = np.searchsorted(self.ends, self.word_at, side="right")
        self.text_words = np.searchsorted(self.word_at, np.r_[self.begins, len(self.bytes)])

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """For each text the sum of a value of its bytes."""
        total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return total[self.ends] - total[self.begins]

    def word_sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum of a value of its words."""
        total = np.r_[0, np.cumsum(values, dtype=np.float64)]
        return total[self.text_words[1:]] - total[self.text_words[:-1]]

    def hashes(self, *cuts: int | None) -> list[np.ndarray]:
        """For each cut the 64-bit hashes of all words' first so many bytes (None: all); 0 for words not longer than the cut."""
        up, down = powers(len(self.bytes))
        total = np.r_[np.uint64(0), np.cumsum(BYTE[self.bytes] * up[: len(self.bytes)])]
        begin, back = total[self.word_at], down[self.word_at]
        out = []
        for cut in cuts:
            end = self.word_end if cut is None else np.minimum(self.word_at + cut, self.word_end)
            h = mix((total[end] - begin) * back + (end - self.word_at).astype(np.uint64) * ODD + np.uint64(0 if cut is None else cut))
            out.append(h if cut is None else np.where(self.word_end - self.word_at > cut, h, np.uint64(0)))
        return out


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def in_blocks(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 18, lower: bool = False) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Slices of the batches of about ``size`` bytes of text each, one row at least; null texts count as empty."""
    for batch in batches:
        at, held, room = 0, [], size
        for i, text in enumerate(batch.column(column)):
            text = text.as_py() or ""
            coded = (text.lower() if lower else text).encode("utf-8")
            if held and len(coded) > room:
                yield batch.slice(at, len(held)), Block(held)
                at, held, room = i, [], size
            held.append(coded)
            room -= len(coded)
        if held:
            yield batch.slice(at, len(held)), Block(held)
    release()
