"""Benchmark passages in documents: Wu-Manber search for all windows of all items at once.

Documents and items become canonical bytes, `` w1 w2 ... wn `` with one space around every word, so a window
of words occurs where its bytes do. Windows of similar length share a table: the shift of a
block of bytes says how far the search may jump when that block ends at a place, since no window's
beginning (cut to the shortest window of the table) holds it later. Where the shift is 0, a bucket chosen by
the hash of that block (and, within it, of the window's first bytes) gives the windows to compare byte by byte. All
places of a text block are searched at once, in lanes that jump on their own.

The tables hold a bounded number of (window, item) pairs; a larger benchmark is searched in shards.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tagmill.operators.common import materialize

from . import words

WINDOW = 10
# (window, item) pairs in one shard: what a task holds and the driver sends at once.
PAIRS = 200_000
# Lengths in bytes where a table of its own begins, so that short windows do not shorten the jumps of long ones.
CLASSES = (1, 6, 12, 24, 48)
# Places in a lane, and longest block of bytes.
LANE, WIDEST = 256, 8

_END = 10
_CANON = np.full(256, 32, np.uint8)
_CANON[48:58] = np.arange(48, 58)
_CANON[97:123] = np.arange(97, 123)
_CANON[65:91] = np.arange(97, 123)
_CANON[128:] = np.arange(128, 256)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Canonical:
    """Texts lo to hi of a column: their words' bytes, a space around each, a line feed after each text."""

    lo: int
    hi: int
    data: np.ndarray  # followed by WIDEST zero bytes
    starts: np.ndarray  # of words
    first: np.ndarray  # number of each text's first word

    @cached_property
    def stops(self) -> np.ndarray:
        """Place after each word."""
        return np.flatnonzero((self.data[:-1] > 32) & (self.data[1:] == 32)) + 1


def canonical_blocks(column, limit: int = words.BLOCK) -> Iterator[Canonical]:
    """The column in blocks of whole texts; a text beyond ``limit`` bytes is a block of its own."""
    offs, raw = words.buffers(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        data = _CANON[raw[offs[lo] : offs[hi]]]
        ends = np.repeat(offs[lo + 1 : hi + 1] - offs[lo], 3)
        data = np.concatenate(([np.uint8(32)], np.insert(data, ends, np.tile(np.array([32, _END, 32], np.uint8), hi - lo))))
        keep = data != 32
        keep[1:] |= data[:-1] != 32
        keep[0] = True
        data = data[keep]
        starts = np.flatnonzero((data[:-1] == 32) & (data[1:] > 32)) + 1
        ends = np.flatnonzero(data == _END)
        first = np.concatenate(([0], np.searchsorted(starts, ends)))
        yield Canonical(lo, hi, np.concatenate((data, np.zeros(WIDEST, np.uint8))), starts, first)
        lo = hi


def windows_of(block: Canonical, i: int, window: int = WINDOW) -> list[bytes]:
    """Distinct windows of the block's i-th text, one space around each word; a shorter text is one window."""
    own = slice(int(block.first[i]), int(block.first[i + 1]))
    starts, stops = block.starts[own] - 1, block.stops[own] + 1
    if not len(starts):
        return []
    n, data = min(window, len(starts)), block.data[starts[0] : stops[-1]].tobytes()
    return list({data[a - starts[0] : b - starts[0]] for a, b in zip(starts, stops[n - 1 :])})


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; ``data`` ends with WIDEST more bytes."""
    return np.ndarray((len(data) - WIDEST + 1,), "<u8", data, strides=(1,))


class Table:
    """Shift table and buckets of windows of at least ``least`` bytes each."""

    def __init__(self, patterns: list[bytes], numbers: np.ndarray):
        self.least = min(map(len, patterns))
        self.width = min(WIDEST, (self.least + 1) // 2)
        lens = np.array([len(p) for p in patterns], np.int64)
        data = np.frombuffer(b"".join(patterns) + bytes(WIDEST), np.uint8)
        begin = np.concatenate(([0], np.cumsum(lens)[:-1]))
        jumps = self.least - self.width + 1  # places of a block in a window's beginning
        self.bits = int(min(22, max(10, np.ceil(np.log2(len(patterns) * jumps)) + 3)))
        blocks = _eight(data)
        self.shift = np.full(1 << self.bits, jumps, np.int32)
        for at in range(jumps):  # later places have smaller shifts and overwrite
            self.shift[self.place(blocks[begin + at])] = jumps - 1 - at
        keys = self.key(blocks[begin + jumps - 1], blocks[begin])
        order = np.argsort(keys, kind="stable")
        self.keys, self.lens, self.begin, self.numbers, self.data = keys[order], lens[order], begin[order], numbers[order], data

    def place(self, eight: np.ndarray) -> np.ndarray:
        """Place in the shift table of the block of ``width`` bytes that each number begins with."""
        return ((eight & _MASKS[self.width]) * _FACTOR >> np.uint64(64 - self.bits)).astype(np.int64)

    def key(self, last: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Bucket (hash of the block at the end of a window's beginning), then hash of its first bytes."""
        head = words.mix(first & _MASKS[self.width]) >> np.uint64(self.bits)
        return self.place(last).astype(np.uint64) << np.uint64(64 - self.bits) | head

    def search(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and window number of every occurrence in canonical bytes."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        blocks, back = _eight(data), self.least - self.width
        last = len(data) - WIDEST - self.least  # the last place a window may start
        if last < 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(0, last + 1, LANE)
        stop = np.minimum(at + LANE, last + 1)
        while len(at):
            shift = self.shift[self.place(blocks[at + back])]
            hit = at[shift == 0]
            if len(hit):
                found.append(self.confirmed(data, blocks, hit))
            at = at + np.maximum(shift, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))

    def confirmed(self, data: np.ndarray, blocks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows in these places' buckets those whose bytes stand there."""
        keys = self.key(blocks[at + self.least - self.width], blocks[at])
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        n = hi - lo
        place = np.repeat(at, n)
        which = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        fits = place + self.lens[which] <= len(data) - WIDEST
        place, which = place[fits], which[fits]
        if not len(place):
            return place, which
        lens = self.lens[which]
        begin = np.concatenate(([0], np.cumsum(lens)[:-1]))
        inside = np.arange(int(lens.sum())) - np.repeat(begin, lens)
        same = data[np.repeat(place, lens) + inside] == self.data[np.repeat(self.begin[which], lens) + inside]
        equal = np.logical_and.reduceat(same, begin)
        return place[equal], self.numbers[which[equal]]


class Matcher:
    """Windows, the items that have them, and the tables to find them by."""

    def __init__(self, patterns: list[bytes], owners: list[list[str | None]]):
        self.lens = np.array([len(p) for p in patterns], np.int64)
        self.names = sorted({o for own in owners for o in own if o is not None})
        number = {name: i for i, name in enumerate(self.names)}
        lists = [sorted({number[o] for o in own if o is not None}) for own in owners]
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        self.items = np.array([i for x in lists for i in x], np.int64)
        self.tables = []
        for low, high in zip(CLASSES, [*CLASSES[1:], 1 << 62]):
            own = np.flatnonzero((self.lens >= low) & (self.lens < high))
            if len(own):
                self.tables.append(Table([patterns[i] for i in own], own))

    def spans(self, block: Canonical) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, word after the last and window number of all occurrences in a block."""
        found = [t.search(block.data) for t in self.tables]
        at = np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)])
        which = np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])
        return np.searchsorted(block.starts, at), np.searchsorted(block.starts, at + self.lens[which] - 1), which

    def found(self, block: Canonical) -> tuple[list, list]:
        """For each text of the block its covered stretches of words (first, after last) and its items."""
        lo, hi, which = self.spans(block)
        texts = block.hi - block.lo
        stretches, items = [[] for _ in range(texts)], [[] for _ in range(texts)]
        if not len(lo):
            return stretches, items
        change = np.bincount(lo, minlength=len(block.starts) + 1) - np.bincount(hi, minlength=len(block.starts) + 1)
        covered = np.concatenate(([False], np.cumsum(change)[:-1] > 0, [False]))
        # a stretch of one text ends where the text does, even if the next begins with one
        covered_at = np.diff(covered.astype(np.int8))
        begin, end = set(np.flatnonzero(covered_at == 1).tolist()), set(np.flatnonzero(covered_at == -1).tolist())
        for cut in block.first[1:-1].tolist():
            if 0 < cut < len(block.starts) and covered[cut] and covered[cut + 1]:
                begin.add(cut)
                end.add(cut)
        for b, e in zip(sorted(begin), sorted(end)):
            text = int(np.searchsorted(block.first, b, "right")) - 1
            stretches[text].append((b - int(block.first[text]), e - int(block.first[text])))
        owner = np.searchsorted(block.first, lo, "right") - 1
        pairs = np.unique(owner * len(self.lens) + which)
        text, which = pairs // len(self.lens), pairs % len(self.lens)
        n = self.first[which + 1] - self.first[which]
        at = np.repeat(self.first[which] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        held = np.unique(np.repeat(text, n) * max(len(self.names), 1) + self.items[at])
        for t, i in zip((held // max(len(self.names), 1)).tolist(), (held % max(len(self.names), 1)).tolist()):
            items[t].append(self.names[i])
        return stretches, items


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (``window``, ``item``) pairs of the items' texts; item is the id as a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in canonical_blocks(batch.column(1)):
                for i in range(block.hi - block.lo):
                    found = windows_of(block, i, window)
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([batch.column(0)[block.lo + i].as_py()] * len(found), pa.string())], ["window", "item"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return rows.mapInArrow(run, "window binary, item string").distinct()


def matchers(benchmark: DataFrame, window: int = WINDOW, pairs: int = PAIRS) -> Iterator[Matcher]:
    """One matcher per shard of about ``pairs`` (window, item) pairs, dealt by hash; at least one."""
    table = materialize(item_windows(benchmark, window))
    shards = -(-table.count() // pairs) or 1
    for s in range(shards):
        own = table.where(F.pmod(F.xxhash64("window", "item"), F.lit(shards)) == s) if shards > 1 else table
        arrow = own.toArrow()  # about ``pairs`` rows
        owners: dict[bytes, list] = {}
        for w, item in zip(arrow["window"].to_pylist(), arrow["item"].to_pylist()):
            owners.setdefault(w, []).append(item)
        yield Matcher(list(owners), list(owners.values()))


def _scan(rows: DataFrame, matcher: Matcher, carry: list[str], every: bool) -> DataFrame:
    """``carry``, ``n_words``, ``spans``, ``items`` of each row of (carry, text), or of those with a hit."""
    shared = rows.sparkSession.sparkContext.broadcast(matcher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in canonical_blocks(batch.column(len(carry))):
                spans, items = shared.value.found(block)
                take = np.arange(block.hi - block.lo) if every else np.array([i for i, s in enumerate(spans) if s], np.int64)
                own = [batch.column(i).slice(block.lo, block.hi - block.lo).take(pa.array(take)) for i in range(len(carry))]
                pairs = [[{"first": a, "stop": b} for a, b in spans[i]] for i in take]
                kind = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(block.first)[take], pa.int64()), pa.array(pairs, kind), pa.array([items[i] for i in take], pa.list_(pa.string()))], [*carry, "n_words", "spans", "items"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", n_words long, spans array<struct<first: int, stop: int>>, items array<string>"
    return rows.select(*[f"`{c}`" for c in carry], "text").mapInArrow(run, schema)


def _merged(spans: Column) -> Column:
    """Spans without overlaps, from sorted ones that may overlap."""
    kind = "array<struct<first: int, stop: int>>"

    def add(done, s):
        last = F.element_at(done, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        return F.when(F.size(done) == 0, F.array(s)).when(s["first"] > last["stop"], F.array_append(done, s)).otherwise(F.array_append(F.slice(done, 1, F.size(done) - 1), joined))

    return F.aggregate(spans, F.array().cast(kind), add)


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pairs: int = PAIRS) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, spans`` (stretches of words inside occurrences,
    first and after last) and ``items`` (ids of the items with an occurring window, as sorted strings).

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. An item's windows are
    its runs of ``window`` words; one of fewer words is one window; a null, empty or wordless one
    has none. Windows of an item without an id make hits but no item; equal ids are one item. A null or empty
    document has no words; each repeated row is searched; empty tables give no rows or no hits; other columns are ignored.

    A benchmark of more than ``pairs`` pairs is searched shard by shard over all documents; only
    rows with hits are shuffled then.
    """
    key = [F.xxhash64("doc_id", "text").alias("__a"), F.xxhash64("text", "doc_id", F.lit(1)).alias("__b")]
    rows, out, more = docs.select("doc_id", *key, "text"), None, []
    for matcher in matchers(benchmark, window, pairs):
        if out is None:
            out = _scan(rows, matcher, ["doc_id", "__a", "__b"], every=True)
        else:  # written out, so that one shard at a time is in memory
            more.append(materialize(_scan(rows, matcher, ["__a", "__b"], every=False)))
    if more:
        rest = more[0]
        for table in more[1:]:
            rest = rest.unionByName(table)
        # at most one row per shard and copy of a document
        rest = rest.groupBy("__a", "__b").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("more_spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("more_items"))
        out = materialize(out).join(rest, ["__a", "__b"], "left")
        both = F.array_sort(F.concat("spans", F.coalesce("more_spans", F.array().cast("array<struct<first: int, stop: int>>"))))
        items = F.array_sort(F.array_union("items", F.coalesce("more_items", F.array().cast("array<string>"))))
        out = out.select("doc_id", "n_words", _merged(both).alias("spans"), items.alias("items"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["first"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), "spans", "items")
