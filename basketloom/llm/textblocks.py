"""Numpy kernels over the UTF-8 bytes of whole Arrow string columns.

A word is a run of bytes outside 0x20 and 0x09-0x0D.  All of those are ASCII, so cutting at bytes never
cuts a character.  Texts are taken in blocks of a few megabytes; a text longer than that forms a block of
its own, so memory is bounded by the block size or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = (1 << 20) - 8

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Base of the rolling sums; 3 modulo 8, so that differences of its powers lose few low bits.
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.Generator(np.random.PCG64(20250101)).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    return _powers(1 << max(20, int(n - 1).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (one-to-one)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


class Block:
    """Consecutive texts as one byte array; ``offs`` has one entry more than there are texts."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, self.n = data, offs, len(offs) - 1
        solid = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:-1]
        self.solid = solid
        self.ws = np.flatnonzero(first)
        self.we = np.flatnonzero(last) + 1
        self.wo = np.searchsorted(self.ws, offs)  # words of text i: wo[i] to wo[i + 1]

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.wo)

    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.wo))

    def span_hash(self, start: np.ndarray, end: np.ndarray, codes: np.ndarray = _CODES, data: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of the bytes from ``start`` to ``end`` of each span, wherever the span lies."""
        data = self.data if data is None else data
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * up[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * U64(0x9E3779B97F4A7C15))

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        return self.span_hash(self.ws, self.we, _CODES[LOWER] if lower else _CODES)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sum of per-byte ``values`` for each text."""
        sums = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=sums[1:])
        return sums[self.offs[1:]] - sums[self.offs[:-1]]

    def per_text_words(self, values: np.ndarray) -> np.ndarray:
        """Sum of per-word ``values`` for each text."""
        sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
        np.cumsum(values, out=sums[1:])
        return sums[self.wo[1:]] - sums[self.wo[:-1]]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes; entry ``i`` starts at word ``i``."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n] + U64(k))


def gram_fits(block: Block, k: int) -> np.ndarray:
    """Whether the ``k`` words from each word on belong to one text (for all but the last ``k - 1`` words)."""
    n = len(block.ws) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    left = np.repeat(block.wo[1:], np.diff(block.wo)) - np.arange(len(block.ws))
    return left[:n] >= k


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(first row, row after the last, block) over a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, Block(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
