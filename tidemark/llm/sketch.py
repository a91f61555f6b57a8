"""Count-min sketches that answer one question, "may this key occur more than once?", built per partition and merged.

Counts saturate at two. A partition sends the cells it touched, sorted and coded as byte gaps, by slice; a slice is merged
by one task, so no task and no message holds a whole sketch. What is broadcast is one bit per cell: at most
ROWS * 2**MOST_BITS bits = 64 MB, however large the input. Beyond the size at which that is roomy, more keys pass;
an exact grouping always follows, so nothing depends on the estimate but cost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = 2
MOST_BITS = 28
SLICES = 64
#: Keys gathered before a partition sends what it has; bounds memory in a task.
FLUSH = 3_000_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
SCHEMA = "slice int, once binary, more binary"
_ARROW = pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])


def width(n_keys: int) -> int:
    """Bits of a row's cell index: about four cells a key, within [2**16, 2**MOST_BITS]."""
    return min(MOST_BITS, max(16, int(4 * max(n_keys, 1) - 1).bit_length()))


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((keys * _MULTIPLIERS[row]) >> np.uint64(64 - bits)).astype(np.int64)


def gaps(sorted_cells: np.ndarray, base: int) -> bytes:
    """Ascending cells as bytes: 255 adds 255 and goes on, any other byte ends a gap."""
    step = np.diff(sorted_cells, prepend=base)
    whole = step // 255
    out = np.full(int(whole.sum()) + len(step), 255, np.uint8)
    out[np.cumsum(whole + 1) - 1] = step % 255
    return out.tobytes()


def ungap(coded: bytes) -> np.ndarray:
    """Inverse of gaps, relative to the base."""
    codes = np.frombuffer(coded, np.uint8)
    return np.cumsum(codes, dtype=np.int64)[codes != 255]


def encode(keys: np.ndarray, bits: int) -> pa.RecordBatch:
    """The sketch of these keys, cut into slices."""
    out: tuple[list, list, list] = ([], [], [])
    span = 1 << (bits - 6)
    for row in range(ROWS):
        touched = np.sort(cells(keys, row, bits))
        lone = np.ones(len(touched), bool)
        same = touched[1:] == touched[:-1]
        lone[1:] &= ~same
        lone[:-1] &= ~same
        head = np.ones(len(touched), bool)
        head[1:] = ~same
        once, more = touched[lone], touched[head & ~lone]
        edges = np.arange(SLICES + 1) * span
        a, b = np.searchsorted(once, edges), np.searchsorted(more, edges)
        for k in range(SLICES):
            if a[k] < a[k + 1] or b[k] < b[k + 1]:
                out[0].append(row * SLICES + k)
                out[1].append(gaps(once[a[k] : a[k + 1]], k * span))
                out[2].append(gaps(more[b[k] : b[k + 1]], k * span))
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], schema=_ARROW)


def encode_stream(keys: Iterator[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for k in keys:
        held.append(k)
        n += len(k)
        if n >= FLUSH:
            yield encode(np.concatenate(held), bits)
            held, n = [], 0
    if n:
        yield encode(np.concatenate(held), bits)


class Repeated:
    """The merged sketch: may_repeat(keys) never misses a key that occurs twice."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def may_repeat(self, keys: np.ndarray) -> np.ndarray:
        keep = np.ones(len(keys), bool)
        for row in range(ROWS):
            at = np.flatnonzero(keep)
            cell = cells(keys[at], row, self.bits)
            keep[at] = (self.packed[row][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1
        return keep


def merged(df: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int):
    """Broadcast of the Repeated sketch over all keys that keys_of draws from df's partitions."""
    span = 1 << (bits - 6)

    def scan(batches):
        yield from encode_stream(keys_of(batches), bits)

    def merge(group: pa.Table) -> pa.Table:
        count = np.zeros(span, np.uint8)
        for once, more in zip(group["once"].to_pylist(), group["more"].to_pylist(), strict=True):
            at = ungap(once)
            count[at] = np.minimum(count[at] + 1, 2)
            count[ungap(more)] = 2
        bitmap = np.packbits(count >= 2, bitorder="little").tobytes()
        return pa.table({"slice": pa.array([group["slice"][0].as_py()], pa.int32()), "bitmap": pa.array([bitmap], pa.binary())})

    slices = df.mapInArrow(scan, SCHEMA).groupBy("slice").applyInArrow(merge, "slice int, bitmap binary")
    packed = np.zeros((ROWS, (1 << bits) // 8), np.uint8)
    for row in slices.toLocalIterator():  # a slice at a time: 2 * 64 slices of a bounded size
        r, k = divmod(row["slice"], SLICES)
        packed[r, k * span // 8 : (k + 1) * span // 8] = np.frombuffer(bytes(row["bitmap"]), np.uint8)
    return df.sparkSession.sparkContext.broadcast(Repeated(bits, packed))
