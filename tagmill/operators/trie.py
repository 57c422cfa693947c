"""Term lists as a trie over tokens, swept over all tokens of a batch at once.

A node is the chained hash of the tokens that lead to it, so the trie is one sorted array of 64-bit keys with
the categories that end there. The sweep looks up every token as a first one, then only those places whose
prefix is in the trie with their next token, and so on: work follows the matches, not the number of
terms, and phrases may have any length.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import barrier_udf
from .sparse import MODEL_BYTES

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
NODE_BYTES = 16


def _chain(key: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hash of a prefix and the token after it."""
    h = (key * _FACTOR) ^ token.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@dataclass
class TokenTrie:
    keys: np.ndarray  # uint64, sorted
    ends: np.ndarray  # uint32: bit c is set where a term of category c ends
    categories: list[str]

    @classmethod
    def of(cls, terms: list[np.ndarray], marks: np.ndarray, categories: list[str]) -> "TokenTrie":
        """``terms`` are arrays of token hashes, ``marks`` the category of each."""
        keys, ends = [], []
        lengths = np.array([len(t) for t in terms], np.int64)
        for n in range(1, int(lengths.max(initial=0)) + 1):
            own = np.flatnonzero(lengths >= n)
            step = np.array([terms[i][n - 1] for i in own], np.int64)
            key = _chain(np.zeros(len(own), np.uint64) if n == 1 else key[keep], step)
            keep = lengths[own] > n
            keys.append(key)
            ends.append(np.where(lengths[own] == n, np.left_shift(1, marks[own]), 0))
        if not keys:
            return cls(np.zeros(0, np.uint64), np.zeros(0, np.uint32), categories)
        keys, ends = np.concatenate(keys), np.concatenate(ends)
        distinct, place = np.unique(keys, return_inverse=True)
        out = np.zeros(len(distinct), np.uint32)
        np.bitwise_or.at(out, place, ends.astype(np.uint32))
        return cls(distinct, out, categories)

    def sweep(self, hashes: np.ndarray, stop: np.ndarray):
        """For n = 1, 2 ...: (n, places where a term of n tokens begins, their category bits).

        ``stop`` is for each token the end of its row; terms do not cross it.
        """
        at, key, n = np.arange(len(hashes)), np.zeros(len(hashes), np.uint64), 0
        while len(at) and len(self.keys):
            n += 1
            key = _chain(key, hashes[at + n - 1])
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[place] == key
            at, key, ends = at[known], key[known], self.ends[place[known]]
            yield n, at[ends > 0], ends[ends > 0]
            more = at + n < stop[at]
            at, key = at[more], key[more]


def token_trie(terms: DataFrame, limit: int = MODEL_BYTES) -> TokenTrie | None:
    """The trie of a table (category, term), terms cut at spaces, if it takes at most ``limit``
    bytes, else None. At most 32 categories."""
    rows = terms.select("category", F.transform(F.split("term", " "), lambda t: F.xxhash64(t)).alias("t")).where("term is not null")
    nodes = rows.agg(F.sum(F.size("t"))).first()[0] or 0
    if nodes * NODE_BYTES > limit:
        return None
    found = rows.toArrow()
    categories = sorted(set(found["category"].to_pylist()))
    marks = np.array([categories.index(c) for c in found["category"].to_pylist()], np.int64)
    return TokenTrie.of([np.array(t, np.int64) for t in found["t"].to_pylist()], marks, categories)


def _stops(lengths: np.ndarray) -> np.ndarray:
    return np.repeat(np.cumsum(lengths), lengths)


def term_bits(df: DataFrame, words: Column, trie: TokenTrie, lengths: dict[str, int]) -> Column:
    """Per token the bits of categories with a term of ``lengths[category]`` tokens that begins there."""
    shared = df.sparkSession.sparkContext.broadcast(trie)
    wanted = {}
    for c, n in lengths.items():
        if c in trie.categories:
            wanted[n] = wanted.get(n, 0) | 1 << trie.categories.index(c)

    @F.arrow_udf("array<bigint>")
    def bits(obs: pa.Array) -> pa.Array:
        sizes = np.asarray(pa.compute.list_value_length(obs).fill_null(0))
        hashes = obs.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros(len(hashes), np.int64)
        for n, at, ends in shared.value.sweep(hashes, _stops(sizes)):
            out[at] |= ends.astype(np.int64) & wanted.get(n, 0)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(out))

    return barrier_udf(bits)(F.transform(words, lambda w: F.xxhash64(w)))


def term_matches(df: DataFrame, terms: DataFrame, words: str = "tokens", limit: int = MODEL_BYTES) -> DataFrame:
    """Add ``terms``: an array of (category, start, length) for every term of any length in a row's words.

    Overlapping and nested terms are all found. A term table beyond ``limit`` bytes is an error here.
    """
    trie = token_trie(terms, limit)
    if trie is None:
        raise ValueError("the term table does not fit; token_features joins it instead")
    shared = df.sparkSession.sparkContext.broadcast(trie)

    @F.arrow_udf("array<struct<category: string, start: int, length: int>>")
    def matches(obs: pa.Array) -> pa.Array:
        own = shared.value
        sizes = np.asarray(pa.compute.list_value_length(obs).fill_null(0))
        stop = _stops(sizes)
        found = []
        for n, at, ends in own.sweep(obs.flatten().to_numpy(zero_copy_only=False), stop):
            for c in range(len(own.categories)):
                hit = at[(ends >> np.uint32(c)) & 1 == 1]
                found.append(np.stack([hit, np.full(len(hit), n), np.full(len(hit), c)], 1))
        table = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        table = table[np.lexsort((table[:, 2], table[:, 1], table[:, 0]))]
        first = np.cumsum(sizes) - sizes
        row = np.searchsorted(np.cumsum(sizes), table[:, 0], side="right")
        parts = [pa.array(own.categories, pa.string()).take(pa.array(table[:, 2])), pa.array((table[:, 0] - first[row]).astype(np.int32)), pa.array(table[:, 1].astype(np.int32))]
        offsets = np.append(0, np.cumsum(np.bincount(row, minlength=len(sizes))))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, ["category", "start", "length"]))

    return df.withColumn("terms", barrier_udf(matches)(F.transform(words, lambda w: F.xxhash64(w))))
