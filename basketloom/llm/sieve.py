"""A bit array over 64-bit keys, of bounded size, for ruling out keys before a shuffle.

It is only ever a sieve: a key whose bit is missing is certainly not in the set, any other key is decided by
the join that follows.  Results do not depend on its size.  It holds at most 2**28 bits: up to some ten million
keys it rules out 19 in 20 of the others; far beyond that it lets everything through, and the joins behind it do
all the work, each linear in its rows.

The array is a table in the shared folder.  Neither the driver nor the JVM ever holds it: each Python worker
reads it once and keeps the last few that it read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset as dataset
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import filesystem, written

#: Parts of the array at most, and the least and most bits of it (32 MB at the most).
PARTS, LEAST_BITS, MOST_BITS = 64, 1 << 20, 1 << 28


@dataclass(frozen=True)
class Sieve:
    path: str
    bits: int

    def load(self) -> np.ndarray:
        """The bits, eight to a byte."""
        return _loaded(self.path, self.bits)


@lru_cache(maxsize=5)
def _loaded(path: str, bits: int) -> np.ndarray:
    files, base = filesystem(path)
    out = np.zeros(bits // 8, np.uint8)
    width = _width(bits) // 8
    for batch in dataset.dataset(base, filesystem=files, format="parquet").to_batches():
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("bits")):
            out[part * width : (part + 1) * width] |= np.frombuffer(raw.as_buffer(), np.uint8)
    return out


def _width(bits: int) -> int:
    return bits // min(PARTS, bits // LEAST_BITS)


def _filler(key: str, bits: int) -> Callable:
    width = _width(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            at = slots(batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False), bits)
            part = at // width
            for p in np.unique(part):
                parts.setdefault(int(p), np.zeros(width, bool))[at[part == p] % width] = True
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([np.packbits(a).tobytes() for a in parts.values()], pa.binary())], names=["part", "bits"])

    return run


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.astype(np.int64, copy=False).view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)


def build(rows: DataFrame, key: str, n: int) -> Sieve:
    """The sieve of the keys (a long column without nulls) of ``rows``; ``n`` is about their number.

    The rows are dealt by part of the array, so each part is made by one task.
    """
    bits = LEAST_BITS
    while bits < 24 * n and bits < MOST_BITS:
        bits *= 2
    width = _width(bits)
    part: Column = F.floor(F.col(key).bitwiseAND(F.lit(bits - 1)) / F.lit(width)).cast("int")
    dealt = rows.select(key).repartition(bits // width, part)
    return Sieve(written(dealt.mapInArrow(_filler(key, bits), "part int, bits binary"), "sieve").table_path, bits)


def may_hold(array: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = slots(keys.view(np.int64), 8 * len(array))
    return (array[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
