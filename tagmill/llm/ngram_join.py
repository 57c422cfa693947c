"""Jaccard self-join of document n-gram sets by vertical partitioning.

All n-grams have one global order: rare ones first, as told by a sketch of counts over all
documents. Documents with equal sets are one class. Two classes that link share one of the first n-grams of both
(prefix filter), so candidates come from the lists of classes per prefix n-gram. Their n-gram sets
are cut into fragments of the hash range; the overlap of a pair is counted in each fragment on its own and
summed per pair.

Pairs are not enumerated where links already connect them: first every class is checked against
its best predecessor along the lists and the centre of most of them, then only pairs of different components that meet in as
many lists as a link asks for are checked. No link between components is lost, so components are
exact.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagmill.operators.common import materialize

from . import bitmaps, words
from .components import connected_components

N, NUMERATOR, DENOMINATOR = 4, 85, 100
SKETCH, FRAGMENTS, FILTER_BITS = 1 << 22, 4, 1 << 24
_SHIFT = np.uint64(64 - 22)  # from a hash to its place in the sketch
# Classes are half steps of the binary logarithm: lists of n-grams that the sketch counts in 2^12
# documents or more are dealt out in parts.
_HOT = 24


def _sets(column, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct n-grams of each text."""
    for b in words.blocks(column, lower=True):
        h = b.hashes()
        g = words.grams(h, n)
        for i, (s, e) in enumerate(zip(b.first[:-1].tolist(), b.first[1:].tolist()), b.lo):
            yield i, np.unique(g[s : e - n + 1]) if e - s >= n else words.gram_set(h[s:e], n)


def set_keys(docs: DataFrame, n: int = N) -> DataFrame:
    """``doc_id, n_shingles, key``: equal keys are equal sets; an empty set has key null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for _, s in _sets(batch.column(1), n):
                sizes.append(len(s))
                keys.append(words.sequence_hash(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())], ["doc_id", "n_shingles", "key"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, key long")


def frequency_classes(docs: DataFrame, n: int = N) -> np.ndarray:
    """For each of ``SKETCH`` hash places twice the binary logarithm of the number of n-grams
    (counted once per document) that fall there: one byte each, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int32)

        def add(held: list[np.ndarray]) -> None:  # a count of all places would take three times the sketch
            place, times = np.unique(np.concatenate(held), return_counts=True)
            counts[place] += times.astype(np.int32)

        for batch in batches:
            held: list[np.ndarray] = []
            for _, s in _sets(batch.column(0), n):
                held.append((s >> _SHIFT).astype(np.int32))
                if len(held) > 1000:
                    add(held)
                    held = []
            if held:
                add(held)
        rows = counts.reshape(bitmaps.BLOCKS, -1)
        full = [b for b in range(bitmaps.BLOCKS) if rows[b].any()]
        for i in range(0, len(full), 32):
            part = full[i : i + 32]
            data = [zlib.compress(rows[b].astype(np.int64).tobytes(), 1) for b in part]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(data, pa.binary())], ["block", "data"])

    def fold(state, data):
        return data.copy() if state is None else (state.view(np.int64) + data.view(np.int64)).view(np.uint8)

    merged = bitmaps.merge(docs.select("text").mapInArrow(run, "block int, data binary"), fold)
    out = np.zeros((bitmaps.BLOCKS, SKETCH // bitmaps.BLOCKS), np.uint8)
    for b, data in merged.items():
        out[b] = np.minimum(2 * np.log2(np.maximum(data.view(np.int64), 1)), 63).astype(np.uint8)
    return out.reshape(-1)


def prefix_lists(docs: DataFrame, classes: np.ndarray, n: int = N, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """``h, key, n, pos`` (its place in the prefix), ``need, early`` and, for all but the first of a list, ``p_key, p_n``.

    One row per class and n-gram ``h`` of its prefix that another class of a similar size has in its prefix too;
    ``p_`` is the class before it in the list of ``h``, by set size. Of all classes of similar sizes in the list, ``need`` is
    a lower bound of ``least_shared``, and only if ``early`` is the row ``is_early`` beside one of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classes)  # SKETCH bytes

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            held: list[tuple] = []
            for _, s in _sets(batch.column(0), n):
                if not len(s) or (key := words.sequence_hash(s)) in seen:
                    continue
                seen.add(key)
                order = shared.value[s >> _SHIFT].astype(np.uint64) << np.uint64(58) | s >> np.uint64(6)
                take = len(s) - -(-num * len(s) // den) + 1
                order = np.sort(np.partition(order, take - 1)[:take] if take < len(order) else order)
                held.append((order, np.full(take, key), np.full(take, len(s)), np.arange(take)))
                if len(held) > 2000:
                    yield _rows(held)
                    held = []
            if held:
                yield _rows(held)

    def _rows(held: list[tuple]) -> pa.RecordBatch:
        h, key, size, pos = (np.concatenate(c) for c in zip(*held))
        spread = np.maximum(((h >> np.uint64(58)).astype(np.int64) - _HOT + 1) // 2, 0)
        salt = words.mix(key.astype(np.int64).view(np.uint64)).view(np.int64) & ((1 << spread) - 1)
        arrays = [pa.array(h.view(np.int64)), pa.array(key, pa.int64()), pa.array(size, pa.int32()), pa.array(salt, pa.int32()), pa.array(pos, pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, ["h", "key", "n", "salt", "pos"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the list that may go on in the next batch: below 2^13 documents, or a part of a hot one
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
            if held is not None:
                cols = [np.concatenate(pair) for pair in zip(held, cols)]
            ends = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[3][1:] != cols[3][:-1])) + 1
            if len(ends):
                yield _linked([c[: ends[-1]] for c in cols])
                cols = [c[ends[-1] :] for c in cols]
            held = cols
        if held is not None and len(held[0]):
            yield _linked(held)

    def _linked(cols: list[np.ndarray]) -> pa.RecordBatch:
        fresh = np.ones(len(cols[0]), bool)
        fresh[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        h, key, size, salt, pos = (c[fresh] for c in cols)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (salt[1:] == salt[:-1])
        before = [np.concatenate(([0], c[:-1])) for c in (key, size)]
        # the smallest and the largest set of a similar size in the list, its own included; parts of hot lists do not tell
        hot = (h.view(np.uint64) >> np.uint64(58)).astype(np.int64) > _HOT
        low, high = -(-num * size // den), den * size // num
        base = np.cumsum(~same) << 32
        first, end = np.searchsorted(base + size, base + low), np.searchsorted(base + size, base + high, "right")
        met = hot | (end - first > 1)
        low, high = np.where(hot, low, size[first]), np.where(hot, high, size[end - 1])
        need = np.minimum(*(_surplus(size, m, num, den) // ((num + den) * den) for m in (low, high)))
        early = 4 * (num + den) * den * pos < 4 * den * ((num + den) * (size + 1) - num * (size + low)) + _surplus(size, low, num, den)
        arrays = [pa.array(h), pa.array(key), pa.array(size, pa.int32()), pa.array(pos, pa.int32())]
        arrays += [pa.array(c, t, mask=~same) for c, t in zip(before, (pa.int64(), pa.int32()))]
        arrays += [pa.array(need), pa.array(early)]
        return pa.RecordBatch.from_arrays(arrays, ["h", "key", "n", "pos", "p_key", "p_n", "need", "early"]).filter(pa.array(met))

    rows = docs.select("text").mapInArrow(emit, "h long, key long, n int, salt int, pos int")
    dealt = rows.repartition("h", "salt").sortWithinPartitions("h", "salt", "n", "key")
    return dealt.mapInArrow(link, "h long, key long, n int, pos int, p_key long, p_n int, need long, early boolean")


def _surplus(n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """``least_shared`` before rounding, times (num + den) * den. It falls as sizes part, so that over a range of ``m`` the
    ends have the least; rounding changes it by less than 1."""
    return den * num * (n + m) - (num + den) * num * np.maximum(n, m) + (num + den) * den


def similar_size(n, m, num: int, den: int):
    """Whether sets of these sizes, the first not larger, can link at all."""
    n, m = (F.col(c) if isinstance(c, str) else c for c in (n, m))
    return den * n.cast("long") >= num * m.cast("long")


def least_shared(n: str, m: str, num: int, den: int):
    """How many n-grams of both prefixes two classes have in common at least if they link.

    What two sets share lies in both prefixes or behind the prefix that ends first; so the
    overlap is at most the shared prefix n-grams and the larger rest.
    """
    n, m = F.col(n).cast("long"), F.col(m).cast("long")
    up = lambda a, b: F.floor((a + (b - 1)) / b)
    return up(num * (n + m), num + den) - up(num * F.greatest(n, m), den) + 1


def least_early(n: str, m: str, num: int, den: int):
    """How many shared n-grams are asked for among the early ones: a quarter of ``least_shared``."""
    return F.floor((least_shared(n, m, num, den) + 3) / 4)


def is_early(pos: str, n: str, m: str, num: int, den: int):
    """Whether a place in the prefix of the class of size ``n`` is so early that a class of size
    ``m`` that links shares at least ``least_early`` n-grams at early places of both: all but
    the overlap asked for, and as many more as are asked for."""
    size, total = F.col(n).cast("long"), F.col(n).cast("long") + F.col(m).cast("long")
    overlap = F.floor((num * total + (num + den - 1)) / (num + den))
    return F.col(pos) < size - overlap + least_early(n, m, num, den)


def overlaps(docs: DataFrame, pairs: DataFrame, n: int = N) -> DataFrame:
    """``x, y, n_x, n_y, common`` for each row (x, y) of distinct ``pairs`` of class keys: fragment by fragment,
    then summed. Only classes that a fixed-size filter holds are cut and shuffled."""
    spark = docs.sparkSession
    keys = pairs.select(F.col("x").alias("key")).union(pairs.select("y"))
    packed = spark.sparkContext.broadcast(bitmaps.key_filter(keys, "key", FILTER_BITS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            held: list[tuple] = []
            for _, s in _sets(batch.column(0), n):
                if not len(s):
                    continue
                key = words.sequence_hash(s)
                if key in seen or not bitmaps.test(packed.value, bitmaps.place(np.array([key]), FILTER_BITS))[0]:
                    continue
                seen.add(key)
                at = np.searchsorted(s, np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(64 - FRAGMENTS.bit_length() + 1))
                for f, part in enumerate(np.split(s.view(np.int64), at)):
                    held.append((key, f, len(s), part))
                if len(held) > 2000:
                    yield _parts(held)
                    held = []
            if held:
                yield _parts(held)

    def _parts(held: list[tuple]) -> pa.RecordBatch:
        key, f, size, part = zip(*held)
        arrays = [pa.array(key, pa.int64()), pa.array(f, pa.int32()), pa.array(size, pa.int64()), pa.array(part, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, ["key", "f", "n", "part"])

    cuts = docs.select("text").mapInArrow(cut, "key long, f int, n long, part array<long>")
    cuts = materialize(cuts.dropDuplicates(["key", "f"]))
    left = pairs.join(cuts.select(F.col("key").alias("x"), "f", F.col("n").alias("n_x"), F.col("part").alias("p_x")), "x")
    both = left.join(cuts.select(F.col("key").alias("y"), "f", F.col("n").alias("n_y"), F.col("part").alias("p_y")), ["y", "f"])
    partial = both.select("x", "y", "n_x", "n_y", F.size(F.array_intersect("p_x", "p_y")).alias("c"))
    return partial.groupBy("x", "y", "n_x", "n_y").agg(F.sum("c").alias("common"))


def many_pairs(open_lists: DataFrame, lists: DataFrame) -> bool:
    """Whether the open lists hold more pairs of classes than all lists have rows. Otherwise forming the pairs costs less
    than another round, which reads all texts and whose many small jobs the driver remembers."""
    pairs = open_lists.groupBy("h").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0
    return pairs > lists.count()


def linked_classes(docs: DataFrame, n: int = N, num: int = NUMERATOR, den: int = DENOMINATOR, rounds: int = 1) -> DataFrame:
    """Edges (x, y) of class keys whose sets link, enough of them to connect every component.

    Each of ``rounds`` checks one or two classes per class and connects what links; pairs are formed
    of what is in different components after the last one only. Rounds end once no ``many_pairs`` are left.
    """
    lists = materialize(prefix_lists(docs, frequency_classes(docs, n), n, num, den))
    # a class shares no more prefix n-grams than it has lists; where a list needs more of it, it links with none of that list
    lists = materialize(lists.join(lists.groupBy("key").agg(F.count("*").alias("d")), "key").where("d >= need"))
    # what to check first: of each class the predecessor it follows in most lists, and the centre
    # (the class in most lists) of most of its lists
    chain = lists.where("p_key is not null").select("key", "n", F.col("p_key").alias("o"), F.col("p_n").alias("m"))
    centre = materialize(lists.groupBy("h").agg(F.max_by(F.struct("key", "n"), F.struct("d", "key")).alias("c")))
    star = lists.join(centre, "h").select("key", "n", F.col("c.key").alias("o"), F.col("c.n").alias("m")).where("key <> o")
    enough = (num + den) * F.col("common") >= num * (F.col("n_x") + F.col("n_y"))

    def best_of(pairs: DataFrame, among_early: bool = False) -> DataFrame:
        """Of each class the other one that it meets in most lists, if their sizes and lists let them link."""
        met = pairs.groupBy("key", "o", "n", "m").count()
        enough_lists = F.col("count") >= least_early("n", "m", num, den) if among_early else 2 * F.col("count") >= least_shared("n", "m", num, den)
        met = met.where(similar_size(F.least("n", "m"), F.greatest("n", "m"), num, den) & enough_lists)
        return met.groupBy("key").agg(F.max_by("o", F.struct("count", "o")).alias("o")).select(F.least("key", "o").alias("x"), F.greatest("key", "o").alias("y"))

    def still_open(edges: DataFrame, checked: DataFrame, rows: DataFrame) -> DataFrame:
        """Of ``rows`` of lists those whose list has classes of different components (``c``), but for lists of two classes
        that are a checked pair."""
        component = connected_components(edges, "x", "y")
        placed = rows.select("h", "key", "n", "pos", "d").join(component.withColumnRenamed("node", "key"), "key", "left").withColumn("c", F.coalesce("component", "key")).drop("component")
        placed = materialize(placed)
        mixed = placed.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("key").alias("x"), F.max("key").alias("y"), F.count("*").alias("size")).where("lo <> hi")
        pair = checked.select("x", "y", F.lit(2).cast("long").alias("size"))
        mixed = materialize(mixed.join(pair.hint("merge"), ["x", "y", "size"], "left_anti").select("h"))
        return materialize(placed.join(mixed, "h", "left_semi"))

    first = materialize(best_of(chain).union(best_of(star)).distinct())
    edges = materialize(overlaps(docs, first, n).where(enough).select("x", "y"))
    # classes that link share n-grams at early places of both; a list that is closed stays so
    open_lists = still_open(edges, first, lists.where("early"))
    for _ in range(rounds - 1):
        if not many_pairs(open_lists, lists):
            break
        # again, with the centres of lists that are open, for classes of other components
        centre = materialize(open_lists.groupBy("h").agg(F.max_by(F.struct("key", "n", "c"), F.struct("d", "key")).alias("o")))
        star = open_lists.join(centre, "h").where("c <> o.c").select("key", "n", F.col("o.key").alias("o"), F.col("o.n").alias("m"))
        new = materialize(best_of(star, True).distinct().join(first, ["x", "y"], "left_anti"))
        first = materialize(first.union(new))
        edges = materialize(edges.union(overlaps(docs, new, n).where(enough).select("x", "y")))
        open_lists = still_open(edges, first, open_lists)
    # what is left: classes of different components that meet in enough lists
    a = open_lists.select("h", *[F.col(c).alias(f"a_{c}") for c in ("key", "n", "pos", "d", "c")])
    b = open_lists.select("h", *[F.col(c).alias(f"b_{c}") for c in ("key", "n", "pos", "d", "c")])
    ahead = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_key") < F.col("b_key")))
    rest = a.join(b, "h").where((F.col("a_c") != F.col("b_c")) & ahead & similar_size("a_n", "b_n", num, den) & (F.least("a_d", "b_d") >= least_shared("a_n", "b_n", num, den)))
    rest = rest.where(is_early("a_pos", "a_n", "b_n", num, den) & is_early("b_pos", "b_n", "a_n", num, den))
    rest = rest.groupBy(F.col("a_key").alias("x"), F.col("b_key").alias("y"), "a_n", "b_n").count()
    rest = rest.where(F.col("count") >= least_early("a_n", "b_n", num, den)).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    rest = materialize(rest.join(first, ["x", "y"], "left_anti"))
    more = overlaps(docs, rest, n).where(enough).select("x", "y")
    return edges.union(more)


def similar_components(docs: DataFrame, n: int = N, num: int = NUMERATOR, den: int = DENOMINATOR, rounds: int = 1) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (smallest id of its component).

    Two documents link when den * common >= num * united n-grams, words being split at ASCII
    white space and A-Z lower-cased. A text with fewer words than n is one n-gram; null and
    empty texts have none and link with nothing. Repeated rows are equal documents; an empty
    table gives an empty one; other columns are ignored. ``rounds`` changes the work, not the result.
    """
    keyed = materialize(set_keys(docs, n))
    edges = materialize(linked_classes(docs, n, num, den, rounds))
    component = connected_components(edges, "x", "y")
    smallest = keyed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("low"))
    placed = smallest.join(component.withColumnRenamed("node", "key"), "key", "left").withColumn("c", F.coalesce("component", "key"))
    placed = materialize(placed.select("key", "c", "low"))
    lowest = placed.groupBy("c").agg(F.min("low").alias("component_id"))
    by_key = materialize(placed.join(lowest, "c").select("key", "component_id"))
    return keyed.join(by_key, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = N, num: int = NUMERATOR, den: int = DENOMINATOR, rounds: int = 3) -> DataFrame:
    """Of each component the document with the smallest id (one row of it), with all columns of
    ``docs``. Documents without words or without id are all kept."""
    found = similar_components(docs, n, num, den, rounds)
    firsts = found.where("doc_id is null or n_shingles = 0 or doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(firsts, docs["doc_id"].eqNullSafe(firsts["__id"]), "left_semi")
    again = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias("__id"))
    again = materialize(again)
    if again.limit(1).count() == 0:
        return kept
    once = kept.join(again, F.col("doc_id") == F.col("__id"), "left_anti")
    return once.unionByName(kept.join(again, F.col("doc_id") == F.col("__id"), "left_semi").dropDuplicates(["doc_id"]))
