"""Removal of lines that many documents share, with two Bloom filters in front of the shuffle.

A first pass puts the hash of every line key into a filter of keys seen once and, on the second
document, into a filter of keys seen twice; the tasks' filters are merged bit by bit (two tasks that have both
seen a key once have seen it twice). Only lines that the second filter may hold are shuffled, to be counted
exactly; lines of one document, the great majority, never leave their partition.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tagmill.functions.let import let
from tagmill.operators.common import materialize

from . import bitmaps, words

MIN_DOCS, MIN_CHARS = 10, 1
# Bits of a filter per line, and the least and most bits of a filter: beyond 32 MB it thins less, and more keys are
# shuffled (16 bytes each) than need be.
BITS_PER_LINE, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 28


def line_keys(text: bytes, min_chars: int) -> dict[bytes, list[int]]:
    """Key (stripped of ASCII white space, A-Z lower-cased) to the numbers of its lines."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.split(b"\n")):
        key = line.strip().lower()
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
            found.setdefault(key, []).append(i)
    return found


def _parts(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about words.BLOCK bytes of text, so that their lines are few at a time."""
    for batch in batches:
        offs, _ = words.buffers(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + words.BLOCK, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _keys(batch: pa.RecordBatch, min_chars: int) -> Iterator[dict[bytes, list[int]]]:
    for text in batch.column(1).cast(pa.binary()).to_pylist():
        yield line_keys(text or b"", min_chars)


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return bitmaps.place(h, bits), bitmaps.place(h, bits, 1)


def _hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def filter_bits(rows: DataFrame) -> int:
    """The power of two of bits that suits the number of lines."""
    lines = rows.agg(F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, 1 << (int(lines) * BITS_PER_LINE - 1).bit_length() if lines else 0))


def twice_seen(rows: DataFrame, min_chars: int, bits: int) -> np.ndarray:
    """Packed Bloom filter that holds every key found in two or more documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for part in _parts(batches):
            h = np.array([_hash(k) for keys in _keys(part, min_chars) for k in keys], np.uint64).view(np.int64)
            h, n = np.unique(h, return_counts=True)
            a, b = _places(h, bits)
            again = (n > 1) | (bitmaps.test(once, a) & bitmaps.test(once, b))
            for at in (a, b):
                bitmaps.set_bits(twice, at[again])
            for at in (a, b):
                bitmaps.set_bits(once, at)
        yield from bitmaps.send_packed([once, twice])

    def fold(state, data):
        if state is None:
            return data.copy()
        (once, twice), (new_once, new_twice) = state.reshape(2, -1), data.reshape(2, -1)
        twice |= new_twice | (once & new_once)
        once |= new_once
        return state

    merged = bitmaps.merge(rows.mapInArrow(scan, "block int, data binary"), fold)
    return bitmaps.assemble({b: a.reshape(2, -1)[1] for b, a in merged.items()}, bits)


def _not_first(found: DataFrame) -> DataFrame:
    """``found`` (common lines by document) without the first copy of each line that copied texts have.

    A text is copied where common lines make up half of its bytes or more. Of each line that any
    copied text has, the copied text with the smallest (doc_id, key) keeps all its occurrences.
    """
    found = materialize(found)
    sizes = F.aggregate(F.collect_set(F.struct("__at", "__size")), F.lit(0).cast("long"), lambda n, x: n + x["__size"])  # a set: repeated rows share a key
    copied = found.groupBy("__k").agg(sizes.alias("__common"), F.max("__all").alias("__all")).where(2 * F.col("__common") >= F.col("__all")).select("__k")
    first = found.join(materialize(copied), "__k").groupBy("__line").agg(F.min(F.struct("doc_id", "__k")).alias("__first"))
    return found.join(first.select("__line", F.col("__first.__k").alias("__k")), ["__line", "__k"], "left_anti")


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, bits: int | None = None, keep_first: bool = False) -> DataFrame:
    """``docs`` with ``text`` freed of common lines, and ``n_lines`` (before), ``n_dropped``.

    A line goes if its key has at least ``min_chars`` code points and occurs in at least
    ``min_docs`` documents, however often in each. Other lines stay as they were, joined by line
    feeds. ``bits`` sets the size of the filters (default: by the number of lines) and changes no result. A null or empty text has one empty line and stays empty; each row is a document, also
    where an id repeats; an empty table gives an empty one. Columns ``n_lines`` and
    ``n_dropped`` of ``docs`` are replaced, all others kept.

    With ``keep_first`` a text that is mostly common lines, as exact and near copies are, does not
    vanish with its copies: of each line in such texts the one with the smallest ``doc_id`` keeps it.
    """
    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(*[F.col(f"`{c}`") for c in own], text.alias("text"), F.xxhash64("doc_id", text).alias("__k"))
    rows = keyed.select("__k", "text", *(["doc_id"] if keep_first else []))
    bits = bits or filter_bits(rows)
    packed = rows.sparkSession.sparkContext.broadcast(twice_seen(rows, min_chars, bits))  # bits / 8 bytes

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            ids, keys, lines, owner, whole = [], [], [], [], []
            for n, (doc, found) in enumerate(zip(batch.column(0).to_pylist(), _keys(batch, min_chars))):
                for key, at in found.items():
                    ids.append(doc)
                    keys.append(key)
                    lines.append(at)
                    owner.append(n)
                whole.append(sum(len(key) * len(at) for key, at in found.items()))
            h = np.array([_hash(k) for k in keys], np.uint64).view(np.int64)
            a, b = _places(h, bits)
            hit = np.flatnonzero(bitmaps.test(packed.value, a) & bitmaps.test(packed.value, b))
            digest = [xxhash.xxh3_128_digest(keys[i]) for i in hit]
            columns = [pa.array(digest, pa.binary()), pa.array([ids[i] for i in hit], pa.int64()), pa.array([lines[i] for i in hit], pa.list_(pa.int32()))]
            names = ["__line", "__k", "__at"]
            if keep_first:
                columns += [batch.column(2).take(pa.array([owner[i] for i in hit], pa.int64()))]
                columns += [pa.array([len(keys[i]) * len(lines[i]) for i in hit], pa.int64()), pa.array([whole[owner[i]] for i in hit], pa.int64())]
                names += ["doc_id", "__size", "__all"]
            yield pa.RecordBatch.from_arrays(columns, names)

    more = f", doc_id {docs.schema['doc_id'].dataType.simpleString()}, __size long, __all long" if keep_first else ""
    found = materialize(rows.mapInArrow(suspects, f"__line binary, __k long, __at array<int>{more}"))
    # written out, so that a line of very many documents can be split in the join
    common = materialize(found.groupBy("__line").count().where(F.col("count") >= min_docs).select("__line"))
    found = found.join(common, "__line")
    drops = (_not_first(found) if keep_first else found).groupBy("__k").agg(F.array_distinct(F.flatten(F.collect_list("__at"))).alias("__drop"))
    joined = keyed.join(drops, "__k", "left").withColumn("__lines", F.split("text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__drop")
    kept = let(lambda lines, at: F.array_join(F.transform(at, lambda i: F.get(lines, i)), "\n"), "__lines", left)
    return joined.select(
        *[F.col(f"`{c}`") for c in own], F.when(F.col("__drop").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.size("__lines").cast("long").alias("n_lines"), F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
