"""A count-min sketch of 64-bit hashes, built over all partitions and merged in blocks.

The sketch answers one question: may a hash occur twice or more? A cell counts up to two, and a
hash is taken to repeat if its cell in every row does, so a hash that repeats is never
missed. Each partition sends its cells (not more than two hits of one) as sorted gaps, cut into
blocks; each block is merged by itself, and one bit a cell is left.

The number of cells follows the input up to `MOST_CELLS`; the merged bits (`ROWS` bits a cell,
128 MB at most) are broadcast. Beyond that the sketch passes more hashes that do not
repeat. That costs the following exact step time, but changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import lean, power_of_two, small_batches
from .words import slices

ROWS = 2
MOST_CELLS = 1 << 29
#: Hashes that a task holds before it sends their cells, and hits in one merged block.
HELD = 4 << 20
BLOCK_HITS = 2 << 20

_MULTIPLIERS = (np.uint64(1), np.uint64(0xC2B2AE3D27D4EB4F))


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((hashes * _MULTIPLIERS[row]) >> np.uint64(64 - bits)).astype(np.uint32)


def pack_gaps(cells: np.ndarray) -> bytes:
    """Sorted cells as bytes: gaps below 255 take one byte, and a byte of 255 carries on; sparse
    cells are stored as they are."""
    gaps = np.diff(cells.astype(np.int64), prepend=0)
    if len(cells) and cells[-1] / len(cells) > 500:
        return b"\1" + cells.astype("<u4").tobytes()
    full, rest = np.divmod(gaps, 255)
    out = np.full(int(full.sum()) + len(gaps), 255, dtype=np.uint8)
    out[np.cumsum(full + 1) - 1] = rest
    return b"\0" + out.tobytes()


def unpack_gaps(data: bytes) -> np.ndarray:
    if data[:1] == b"\1":
        return np.frombuffer(data, dtype="<u4", offset=1)
    steps = np.frombuffer(data, dtype=np.uint8, offset=1)
    return np.cumsum(steps, dtype=np.int64)[steps != 255].astype(np.uint32)


class Repeated:
    """The merged sketch, as tasks use it."""

    def __init__(self, bits: int, rows: list[np.ndarray]):
        self.bits, self.rows = bits, rows

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may repeat."""
        out = np.ones(len(hashes), dtype=bool)
        for row, table in enumerate(self.rows):
            cell = cells_of(hashes, row, self.bits)
            out &= (table[cell >> np.uint32(3)] >> (cell & np.uint32(7)).astype(np.uint8)) & np.uint8(1) != 0
        return out


def build(texts: DataFrame, hashes: Callable[[pa.Array], np.ndarray], expected: float,
          cells_each: float = 4) -> Repeated:
    """The sketch of all hashes of the one text column of `texts`; `expected`: about how many,
    `cells_each`: cells of a row for each of them."""
    cells = power_of_two(cells_each * expected, 1 << 16, MOST_CELLS)
    blocks = power_of_two(expected / BLOCK_HITS, 64, cells >> 10)
    bits, block_bits = cells.bit_length() - 1, (cells // blocks).bit_length() - 1

    def payloads(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hits = np.concatenate(held)
        for row in range(ROWS):
            cell = np.sort(cells_of(hits, row, bits))
            third = np.zeros(len(cell), dtype=bool)
            third[2:] = cell[2:] == cell[:-2]
            cell = cell[~third]
            edge = np.searchsorted(cell, np.arange(blocks + 1, dtype=np.uint64) << np.uint64(block_bits))
            full = np.flatnonzero(np.diff(edge))
            inner = cell & np.uint32((1 << block_bits) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(full), row, np.int32)), pa.array(full.astype(np.int32)),
                 pa.array([pack_gaps(inner[edge[b]:edge[b + 1]]) for b in full], pa.binary())],
                names=["row", "block", "cells"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            column = batch.column(0)
            for a, b in slices(column):
                held.append(hashes(column.slice(a, b - a)))
                n += len(held[-1])
                if n >= HELD:
                    yield from payloads(held)
                    held, n = [], 0
        if n:
            yield from payloads(held)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        cell = np.sort(np.concatenate([unpack_gaps(x) for x in table.column("cells").to_pylist()]))
        twice = np.zeros(1 << block_bits, dtype=bool)
        twice[cell[1:][cell[1:] == cell[:-1]]] = True
        return pa.table({"row": table.column("row").slice(0, 1), "block": table.column("block").slice(0, 1),
                         "bits": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})

    merged = (small_batches(texts).mapInArrow(lean(count), "row int, block int, cells binary").groupBy("row", "block")
              .applyInArrow(merge, "row int, block int, bits binary"))
    size = (1 << block_bits) // 8
    rows = [np.zeros(cells // 8, dtype=np.uint8) for _ in range(ROWS)]
    for row, block, data in merged.toLocalIterator():  # at most ROWS * MOST_CELLS / 8 bytes in all
        rows[row][block * size:(block + 1) * size] = np.frombuffer(data, dtype=np.uint8)
    return Repeated(bits, rows)
