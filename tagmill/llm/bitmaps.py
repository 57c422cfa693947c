"""Bit arrays of fixed size, filled by all tasks and merged without passing through one.

Each task keeps its own arrays and sends the blocks that hold anything, compressed; blocks are
merged where Spark deals them. The size is a parameter, so what comes to the driver is bounded
whatever the input; too few bits only let more rows pass on to an exact check.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCKS = 64
# Tasks that merge; they read their blocks as a stream.
MERGERS = 32


def send(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Packed 0/1 arrays of equal length as rows (block, data)."""
    packed = [np.packbits(a).reshape(BLOCKS, -1) for a in arrays]
    rows = [(b, zlib.compress(np.concatenate([p[b] for p in packed]).tobytes(), 1)) for b in range(BLOCKS) if any(p[b].any() for p in packed)]
    for i in range(0, len(rows), 64):
        part = rows[i : i + 64]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.binary())], ["block", "data"])


def send_packed(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The same for arrays that are packed already."""
    packed = [a.reshape(BLOCKS, -1) for a in arrays]
    for b in range(BLOCKS):
        if any(p[b].any() for p in packed):
            data = zlib.compress(np.concatenate([p[b] for p in packed]).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([data], pa.binary())], ["block", "data"])


def set_bits(packed: np.ndarray, at: np.ndarray) -> None:
    """Set the bits at these places."""
    np.bitwise_or.at(packed, at >> 3, (128 >> (at & 7)).astype(np.uint8))


def merge(rows: DataFrame, fold) -> dict[int, np.ndarray]:
    """One array per block. ``fold(state or None, data)`` takes each row's data; the states come
    to the driver, one per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                state[block] = fold(state.get(block), np.frombuffer(zlib.decompress(data), np.uint8))
        for block, array in state.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(array.tobytes(), 1)], pa.binary())], ["block", "data"])

    merged = rows.repartition(MERGERS, "block").mapInArrow(run, "block int, data binary")
    return {r[0]: np.frombuffer(zlib.decompress(bytes(r[1])), np.uint8) for r in merged.collect()}


def union(state: np.ndarray | None, data: np.ndarray) -> np.ndarray:
    return data.copy() if state is None else np.bitwise_or(state, data, out=state)


def assemble(blocks: dict[int, np.ndarray], bits: int) -> np.ndarray:
    """The packed bits of all blocks in order."""
    out = np.zeros((BLOCKS, bits // 8 // BLOCKS), np.uint8)
    for b, array in blocks.items():
        out[b] = array
    return out.reshape(-1)


def test(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits at these places are set."""
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def key_filter(table: DataFrame, column: str, bits: int) -> np.ndarray:
    """A packed bit array with the hash place of every value of a bigint column set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, np.uint8)
        for batch in batches:
            seen[place(batch.column(0).to_numpy(zero_copy_only=False), bits)] = 1
        yield from send([seen])

    return assemble(merge(table.select(column).mapInArrow(run, "block int, data binary"), union), bits)


def place(keys: np.ndarray, bits: int, seed: int = 0) -> np.ndarray:
    """Place of 64-bit keys in an array of ``bits`` (a power of two)."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF | 1)
    return (h >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
