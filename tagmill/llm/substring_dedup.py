"""Removal of repeated word passages with suffix automata of reference shards.

Windows of ``LENGTH`` words that occur earlier (in a document of smaller id, or before in the
same one) are removed. A window belongs to the shard of its smallest hash of ``GRAM`` words, so
equal windows meet, and a document is a row of runs: neighbouring windows of one shard. Equal
runs are settled by order alone. Where runs of a shard differ, its suffix automaton is built in
order of documents and each run is streamed through it for matching statistics; a match
of ``LENGTH`` words or more ends an earlier occurrence. Automata stay in the tasks that build
them and runs are dealt to them, since automata of the whole input are too large to broadcast.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagmill.operators.common import materialize

from . import bitmaps, words

LENGTH, GRAM = 20, 6
SKETCH, FILTER_BITS = 1 << 20, 1 << 25
# A shard is hot if the sketch counts 2^10 runs or more, and 2^4 times the mean.
_HOT, _OVER_MEAN = 10, 4
# Shards with more different runs than this are settled window by window.
_RUNS = 4096
_LOWEST = -(1 << 63)


def _inverse(x: int) -> int:
    y = 1
    for _ in range(7):
        y = y * (2 - x * y) & (1 << 64) - 1
    return y


def runs(column, length: int, gram: int) -> Iterator[tuple]:
    """Per block: row number, first word, number of windows, shard, content hash and whether a
    window repeats, of every run; then the word hashes and the first word of each text."""
    for b in words.blocks(column):
        h = b.hashes()
        n = len(h) - length + 1
        if n <= 0:
            continue
        owner = np.repeat(np.arange(b.lo, b.hi), b.counts())
        least, span = words.grams(h, gram), 1
        want = length - gram + 1
        while 2 * span <= want:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        least = np.minimum(least[: len(least) - (want - span)], least[want - span :])
        at = np.flatnonzero(owner[:n] == owner[length - 1 :])
        if not len(at):
            continue
        shard = least[at]
        edge = np.ones(len(at), bool)
        edge[1:] = (shard[1:] != shard[:-1]) | (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
        begin = np.flatnonzero(edge)
        size = np.diff(np.concatenate((begin, [len(at)])))
        # hashes of word ranges from prefix sums
        up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(h), words._BASE, np.uint64))), dtype=np.uint64)
        down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(h), _inverse(words._BASE), np.uint64))), dtype=np.uint64)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:-1], dtype=np.uint64)))
        start = at[begin]
        content = words.mix((total[start + size + length - 1] - total[start]) * down[start] + size.astype(np.uint64))
        window = words.mix((total[at + length] - total[at]) * down[at])
        number = np.repeat(np.arange(len(begin)), size)
        key = window ^ words.mix(number + 1)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(begin), bool)
        twice[number[order[1:][same]]] = True
        row = owner[start]
        yield row, start - b.first[row - b.lo], size, shard[begin].view(np.int64), content.view(np.int64), twice, h, start


def _identified(docs: DataFrame) -> DataFrame:
    """``text, doc`` (order of documents; null first) and ``tie`` (tells apart rows of one id)."""
    text = F.coalesce("text", F.lit(""))
    tie = F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    return docs.select(text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("doc"), tie.alias("tie"))


def shard_sizes(rows: DataFrame, length: int, gram: int) -> tuple[np.ndarray, int]:
    """Binary logarithm of the number of runs per hash place (``SKETCH`` bytes), and from which on a shard is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for r in runs(batch.column(0), length, gram):
                counts += np.bincount(bitmaps.place(r[3], SKETCH), minlength=SKETCH)
        parts = counts.reshape(bitmaps.BLOCKS, -1)
        full = [b for b in range(bitmaps.BLOCKS) if parts[b].any()]
        for i in range(0, len(full), 32):
            own = full[i : i + 32]
            data = [zlib.compress(parts[b].tobytes(), 1) for b in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(data, pa.binary())], ["block", "data"])

    def fold(state, data):
        return data.copy() if state is None else (state.view(np.int64) + data.view(np.int64)).view(np.uint8)

    merged = bitmaps.merge(rows.select("text").mapInArrow(run, "block int, data binary"), fold)
    counts = np.zeros((bitmaps.BLOCKS, SKETCH // bitmaps.BLOCKS), np.int64)
    for b, data in merged.items():
        counts[b] = data.view(np.int64)
    mean = counts.sum() / SKETCH
    hot = max(_HOT, int(np.log2(max(mean, 1))) + _OVER_MEAN)
    return np.log2(np.maximum(counts.reshape(-1), 1)).astype(np.int8), hot


def settled(rows: DataFrame, sizes: np.ndarray, hot: int, length: int, gram: int) -> DataFrame:
    """Runs of shards with more than one: ``shard, content, doc, tie, start, n, again`` (it
    equals an earlier run), ``twice`` (one of its windows repeats inside it) and ``hot``.

    Runs are sorted per shard; those of hot shards are dealt out in parts first, in each of
    which the first of equal runs is kept open.
    """
    shared = rows.sparkSession.sparkContext.broadcast(sizes)  # SKETCH bytes

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for row, start, size, shard, content, twice, _, _ in runs(batch.column(0), length, gram):
                spread = np.maximum(shared.value[bitmaps.place(shard, SKETCH)].astype(np.int64) - hot + 1, 0)
                salt = words.mix(doc[row].astype(np.int64).view(np.uint64) ^ shard.view(np.uint64)).view(np.int64) & ((1 << spread) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), pa.array(np.where(spread > 0, salt + 1, 0), pa.int32()), pa.array(content), pa.array(doc[row], pa.int64()), pa.array(tie[row], pa.int32()), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(twice)],
                    ["shard", "salt", "content", "doc", "tie", "start", "n", "twice"],
                )

    names = ["shard", "content", "doc", "tie", "start", "n", "again", "twice", "hot"]

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last row, which may still get a neighbour
        alone = True
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(8)]
            offset = 0 if held is None else 1
            if held is not None:
                cols = [np.concatenate((a, b)) for a, b in zip(held, cols)]
            same = np.zeros(len(cols[0]), bool)
            same[1:] = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
            again = same.copy()
            again[1:] &= cols[2][1:] == cols[2][:-1]
            if offset:
                same[0], again[0] = not alone, held_again
            held = [c[-1:] for c in cols]
            yield from _settled(cols, same, again, slice(0, -1), np.append(same[1:], False))
            alone, held_again = not same[-1], bool(again[-1])
        if held is not None:
            yield from _settled(held, np.array([not alone]), np.array([held_again]), slice(0, 1), np.array([False]))

    def _settled(cols, same, again, part, following) -> Iterator[pa.RecordBatch]:
        shard, salt, content, doc, tie, start, n, twice = (c[part] for c in cols)
        keep = same[part] | following[part] | (twice > 0) | (salt > 0)
        if keep.any():
            arrays = [pa.array(c[keep], t) for c, t in zip((shard, content, doc, tie, start, n), (pa.int64(),) * 3 + (pa.int32(),) * 3)]
            arrays += [pa.array(again[part][keep]), pa.array(twice[keep] > 0), pa.array(salt[keep] > 0)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    found = rows.mapInArrow(emit, "shard long, salt int, content long, doc long, tie int, start int, n int, twice boolean")
    dealt = found.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "content", "doc", "tie", "start")
    return dealt.mapInArrow(sort_out, "shard long, content long, doc long, tie int, start int, n int, again boolean, twice boolean, hot boolean")


class Automaton:
    """Suffix automaton over words that grows while it is read: ``feed`` tells how long a suffix
    of what has been fed since ``restart`` occurred before."""

    __slots__ = ("next", "link", "size", "last", "at", "match")

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]
        self.last = self.at = self.match = 0

    def restart(self) -> None:
        self.last = self.at = self.match = 0

    def feed(self, word) -> int:
        nxt, link, size = self.next, self.link, self.size
        at, match = self.at, self.match
        while at and word not in nxt[at]:
            at = link[at]
            match = size[at]
        if word in nxt[at]:
            at = nxt[at][word]
            match += 1
        self._extend(word)
        while link[at] >= 0 and size[link[at]] >= match:  # a state may have been split
            at = link[at]
        self.at, self.match = at, match
        return match

    def _extend(self, word) -> None:
        nxt, link, size = self.next, self.link, self.size
        p = self.last
        if word in nxt[p]:
            q = nxt[p][word]
            self.last = q if size[q] == size[p] + 1 else self._split(p, q, word)
            return
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[p] + 1)
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[cur] = q if size[q] == size[p] + 1 else self._split(p, q, word)
        self.last = cur

    def _split(self, p: int, q: int, word) -> int:
        nxt, link, size = self.next, self.link, self.size
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        return clone


def repeats(sequences, length: int) -> Iterator[list[int]]:
    """For each sequence of words, in order, the starts of windows that occurred earlier."""
    automaton = Automaton()
    for sequence in sequences:
        automaton.restart()
        yield [i - length + 1 for i, w in enumerate(sequence) if automaton.feed(w) >= length]


def matched(rows: DataFrame, need: DataFrame, length: int, gram: int) -> DataFrame:
    """``doc, tie, start, n`` of repeated windows among the runs of ``need`` (those that
    ``settled`` left open): automata for most shards, grouped windows for those of very many runs."""
    packed = rows.sparkSession.sparkContext.broadcast(bitmaps.key_filter(need, "shard", FILTER_BITS))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for row, start, size, shard, _, _, h, at in runs(batch.column(0), length, gram):
                hit = np.flatnonzero(bitmaps.test(packed.value, bitmaps.place(shard, FILTER_BITS)))
                for part in np.array_split(hit, len(hit) // 20_000 + 1):
                    n = size[part] + length - 1
                    offsets = np.concatenate(([0], np.cumsum(n)))
                    index = np.repeat(at[part] - offsets[:-1], n) + np.arange(offsets[-1])
                    own = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h[index].view(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard[part]), pa.array(doc[row[part]], pa.int64()), pa.array(tie[row[part]], pa.int32()), pa.array(start[part], pa.int32()), own],
                        ["shard", "doc", "tie", "start", "own"],
                    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton, place = None, Automaton(), None
        for batch in batches:
            shards, docs, ties, starts = (batch.column(i).to_pylist() for i in range(4))
            out: list[tuple] = []
            lists = batch.column(4)
            flat, offs = lists.values.to_pylist(), lists.offsets.to_pylist()
            for i, s in enumerate(shards):
                if s != shard:
                    shard, automaton = s, Automaton()
                elif (docs[i], ties[i], starts[i]) == place:
                    continue  # the same row of a repeated table row
                place = (docs[i], ties[i], starts[i])
                automaton.restart()
                feed, first = automaton.feed, None
                for j, w in enumerate(flat[offs[i] : offs[i + 1]]):
                    if feed(w) >= length:
                        first = j if first is None else first
                    elif first is not None:
                        out.append((docs[i], ties[i], starts[i] + first - length + 1, j - first))
                        first = None
                if first is not None:
                    out.append((docs[i], ties[i], starts[i] + first - length + 1, offs[i + 1] - offs[i] - first))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc", "tie", "start", "n"])

    key = ["shard", "doc", "tie", "start"]
    cut = rows.mapInArrow(emit, "shard long, doc long, tie int, start int, own array<long>")
    cut = materialize(cut.join(need.select(*key, "n", "large").distinct(), key))
    cold = cut.where("not large").select(*key, "own").repartition("shard").sortWithinPartitions(*key)
    found = cold.mapInArrow(stream, "doc long, tie int, start int, n int")
    # large shards: every window by its own hash
    windows = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.xxhash64(F.slice("own", i + 1, F.lit(length))).alias("w"), (F.col("start") + i).alias("s")))
    each = cut.where("large").select("shard", "doc", "tie", F.explode(windows).alias("x")).select("shard", "doc", "tie", "x.w", F.col("x.s").alias("start"))
    first = each.groupBy("shard", "w").agg(F.min(F.struct("doc", "tie", "start")).alias("f"))
    later = each.join(first, ["shard", "w"]).where(F.struct("doc", "tie", "start") != F.col("f"))
    return found.union(later.select("doc", "tie", "start", F.lit(1).alias("n")))


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc, tie, start, n``: windows ``start`` to ``start + n - 1`` of the document occur earlier."""
    rows = _identified(docs)
    sizes, hot = shard_sizes(rows, length, gram)
    known = materialize(settled(rows, sizes, hot, length, gram))
    first = known.where("not again")
    shards = first.groupBy("shard").agg(F.min("content").alias("lo"), F.max("content").alias("hi"), F.max("twice").alias("t"), F.max("hot").alias("h"), F.count("*").alias("c"))
    open_shards = materialize(shards.where("lo <> hi or t or (h and c > 1)").select("shard", (F.col("c") > _RUNS).alias("large")))
    need = materialize(first.join(open_shards, "shard").select("shard", "doc", "tie", "start", "n", "large"))
    return known.where("again").select("doc", "tie", "start", "n").union(matched(rows, need, length, gram))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with ``text`` as the kept words joined by one space, ``n_words`` and ``n_removed``.

    Words are split at ASCII white space and compared as they are. All windows are judged on
    the input. Null and empty texts have no words; texts under ``length`` words lose none. Rows
    that repeat an id and text are one document and judged alike; rows of one id with different texts are ordered by a hash of the
    text. An empty table gives an empty one. Columns ``n_words`` and ``n_removed`` of ``docs``
    are replaced, all others kept.
    """
    own = [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    spans = repeated_windows(docs, length, gram).groupBy(F.col("doc").alias("__doc"), F.col("tie").alias("__tie"))
    spans = spans.agg(F.collect_list(F.struct("start", "n")).alias("__s"))
    keyed = docs.select(*[F.col(f"`{c}`") for c in own], F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)), "__tie": F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")})
    joined = keyed.join(spans, ["__doc", "__tie"], "left").select(*[F.col(f"`{c}`") for c in own], "text", F.col("__s.start").alias("__at"), F.col("__s.n").alias("__n"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_columns - 3
            at, n = batch.column(k + 1), batch.column(k + 2)
            for b in words.blocks(batch.column(k)):
                change = np.zeros(len(b.starts) + 1, np.int64)
                starts, sizes = at.slice(b.lo, b.hi - b.lo), n.slice(b.lo, b.hi - b.lo)
                counts = [len(x) if x is not None else 0 for x in starts.to_pylist()]
                s = np.array([x for y in starts.to_pylist() if y for x in y], np.int64) + np.repeat(b.first[:-1], counts)
                z = np.array([x for y in sizes.to_pylist() if y for x in y], np.int64)
                np.add.at(change, s, 1)
                np.add.at(change, s + z + length - 1, -1)
                gone = np.cumsum(change)[:-1] > 0
                data = b.data.tobytes()
                starts_, ends_ = b.starts.tolist(), b.ends.tolist()
                texts, removed = [], []
                for i, j in zip(b.first[:-1].tolist(), b.first[1:].tolist()):
                    texts.append(b" ".join([data[starts_[w] : ends_[w]] for w in (np.flatnonzero(~gone[i:j]) + i).tolist()]))
                    removed.append(int(gone[i:j].sum()))
                columns = [batch.column(i).slice(b.lo, b.hi - b.lo) for i in range(k)]
                columns += [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(b.counts(), pa.int64()), pa.array(removed, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*own, "text", "n_words", "n_removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.select(*own).schema)
    return joined.mapInArrow(apply, f"{schema}, text string, n_words long, n_removed long")
