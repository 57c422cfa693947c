"""Model tables for tasks: sorted key hashes, offsets, and the state and value of each entry.

A key costs 16 bytes and an entry 10, whatever the number of states; vectors over all states exist
only for the tokens of one block that is being decoded. Keys are told apart by a 64-bit hash.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

# What may travel to every task.
MODEL_BYTES = 64 << 20
ENTRY_BYTES = 16 + 10  # at most: an entry with a key of its own


@dataclass
class SparseRows:
    keys: np.ndarray  # int64, sorted, distinct
    offsets: np.ndarray  # int64, one more than keys
    states: np.ndarray  # uint16
    values: np.ndarray  # float64

    @classmethod
    def of(cls, keys: np.ndarray, states: np.ndarray, values: np.ndarray) -> "SparseRows":
        order = np.lexsort((states, keys))
        distinct, first = np.unique(keys[order], return_index=True)
        return cls(distinct.astype(np.int64), np.append(first, len(keys)).astype(np.int64), states[order].astype(np.uint16), values[order].astype(np.float64))

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.offsets.nbytes + self.states.nbytes + self.values.nbytes

    def entries(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every entry of each known hash: which hash it was asked for by, and its place."""
        if not len(self.keys) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        n = np.where(self.keys[row] == hashes, self.offsets[row + 1] - self.offsets[row], 0)
        asked = np.repeat(np.arange(len(hashes)), n)
        return asked, np.repeat(self.offsets[row] - (np.cumsum(n) - n), n) + np.arange(len(asked))

    def replaced(self, hashes: np.ndarray, default: np.ndarray) -> np.ndarray:
        """A vector per hash: ``default`` but for the states that have an entry."""
        out = np.tile(default, (len(hashes), 1))
        asked, at = self.entries(hashes)
        out[asked, self.states[at]] = self.values[at]
        return out

    def summed(self, hashes: np.ndarray, owner: np.ndarray, n: int, base: np.ndarray) -> np.ndarray:
        """A vector per owner (0 to n - 1): ``base`` plus the entries of all hashes it owns."""
        k = len(base)
        asked, at = self.entries(hashes)
        return np.bincount(owner[asked] * k + self.states[at], self.values[at], n * k).reshape(n, k) + base


def state_index(states: list[str], column) -> Column:
    return (F.array_position(F.array(*[F.lit(s) for s in states]), F.col(column)) - 1).cast("int")


def sparse_rows(table: DataFrame, key: str, value: str, states: list[str], limit: int = MODEL_BYTES) -> SparseRows | None:
    """The table (key, state, value) as sparse rows if it takes at most ``limit`` bytes, else None."""
    most = limit // ENTRY_BYTES
    own = table.where(F.col("state").isin(states)) if len(states) else table.limit(0)
    if own.limit(most + 1).count() > most:
        return None
    rows = own.select(F.xxhash64(key).alias("k"), state_index(states, "state").alias("s"), F.col(value).cast("double").alias("v")).toArrow()
    return SparseRows.of(*[rows[c].to_numpy() for c in ("k", "s", "v")])
