"""Records that do not end with the line: reading one large file with many tasks.

A file is cut by Spark into splits of text pieces, which a scan sees in order. Each split hands out the
records that lie wholly inside it; what its first record began with, or its last one lacks, are fragments. A prefix
sum over the splits of a file tells where each fragment belongs, and only fragments are shuffled: two per
split at most, whatever the size of the file.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.common import materialize

# Whole records; the end, middle or beginning of one that other splits share.
WHOLE, END, MIDDLE, BEGIN = 0, 1, 2, 3
_OUT = "file string, start bigint, no bigint, kind int, text string"


def pieces(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """``file``, ``start`` (of the split) and ``value`` of the pieces between delimiters, in order in each task."""
    rows = spark.read.option("lineSep", delimiter).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def runs(batches: Iterator[pa.RecordBatch], delimiter: str) -> Iterator[tuple[tuple[str, int], str, dict]]:
    """(File, start), text and first row of each stretch of one split in a batch; its pieces end with the delimiter."""
    for batch in batches:
        if not batch.num_rows:
            continue
        starts, files = batch.column("start").to_numpy(zero_copy_only=False), batch.column("file").dictionary_encode()
        codes = np.asarray(files.indices)
        cuts = np.flatnonzero((np.diff(starts) != 0) | (np.diff(codes) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(starts)]):
            text = delimiter.join(batch.column("value").slice(a, b - a).to_pylist()) + delimiter
            yield (files.dictionary[int(codes[a])].as_py(), int(starts[a])), text, batch.slice(a, 1).drop_columns(["value"]).to_pylist()[0]


def joined(found: DataFrame) -> DataFrame:
    """``file`` and ``text`` of all records, fragments put together.

    ``found`` has rows of _OUT, where ``no`` orders the rows of a split. The number of beginnings up to a fragment
    names its record; a split has at most one of each kind, so a file's fragments are few.
    """
    found = materialize(found)
    whole = found.where(F.col("kind") == WHOLE).select("file", "text")
    parts = found.where(F.col("kind") != WHOLE)
    # an end stands before a beginning of the same split
    upto = Window.partitionBy("file").orderBy("start", "no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keyed = parts.withColumn("record", F.sum((F.col("kind") == BEGIN).cast("long")).over(upto))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "no", "text"))), lambda x: x["text"]), "")
    return whole.unionByName(keyed.groupBy("file", "record").agg(text.alias("text")).select("file", "text"))


# --- logs: records between separators ---------------------------------------------------------


def split_by(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``file`` and ``text`` of the stretches between matches of a regular expression, which must not
    match a line feed. Files are split among tasks; no width of the separator need be known."""
    pattern = re.compile(separator)
    lines = pieces(spark, path, "\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, no, cut = None, [], 0, False

        def end():
            """What the split leaves: the beginning of a record, or no separator at all."""
            return (*at, no, BEGIN if cut else MIDDLE, "".join(held))

        for split, text, _ in runs(batches, "\n"):
            rows = []
            if at != split:
                if at is not None:
                    rows.append(end())
                at, held, no, cut = split, [], 0, False
            parts = pattern.split(text)
            for part in parts[:-1]:
                held.append(part)
                rows.append((*at, no, WHOLE if cut else END, "".join(held)))
                held, no, cut = [], no + 1, True
            held.append(parts[-1])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=_SCHEMA)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in end()], schema=_SCHEMA)

    return joined(lines.mapInArrow(run, _OUT))


_SCHEMA = pa.schema([("file", pa.string()), ("start", pa.int64()), ("no", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])


# --- JSON: the objects of one large array ------------------------------------------------------


def structure(data: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """Depth after each byte, from 0, and whether the bytes end inside a string.

    ``inside`` says whether they begin inside one. Braces and brackets in strings do not count; a quote after an
    odd number of backslashes does not end a string.
    """
    at = np.arange(len(data))
    before = np.concatenate(([-1], np.maximum.accumulate(np.where(data != 92, at, -1))[:-1]))  # last other byte
    quote = (data == 34) & ((at - 1 - before) % 2 == 0)
    within = (np.cumsum(quote) + inside) % 2 == 1
    opens, closes = (data == 123) | (data == 91), (data == 125) | (data == 93)
    return np.cumsum(np.where(within, 0, opens.astype(np.int64) - closes)), bool(within[-1]) if len(data) else inside


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``text`` of every object in files that hold one JSON array of objects each.

    Pieces end at closing braces, before which no escape can be open, so a piece changes depth and string
    state in one of two ways that do not depend on what stands before. A first scan sums both ways per split; the
    second knows how each split begins.
    """
    rows = pieces(spark, path, "}")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, outside, inside, flips = None, 0, 0, False
        done = lambda: pa.RecordBatch.from_arrays([pa.array([v]) for v in (*at, outside, inside, flips)], ["file", "start", "outside", "inside", "flips"])
        for split, text, _ in runs(batches, "}"):
            if at != split:
                if at is not None:
                    yield done()
                at, outside, inside, flips = split, 0, 0, False
            data = np.frombuffer(text.encode(), np.uint8)
            depth, ends = structure(data, flips)
            outside += int(depth[-1])
            inside += int(structure(data, not flips)[0][-1])
            flips = ends
        if at is not None:
            yield done()

    # flips: whether a split turns "outside a string" into "inside", which holds both ways round
    per_split = materialize(rows.mapInArrow(totals, "file string, start bigint, outside bigint, inside bigint, flips boolean"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begin = per_split.withColumn("within", F.coalesce(F.sum(F.col("flips").cast("int")).over(before), F.lit(0)) % 2 == 1)
    begin = begin.withColumn("change", F.when(F.col("within"), F.col("inside")).otherwise(F.col("outside")))
    begin = materialize(begin.select("file", "start", "within", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth")))
    # one row per split of 128 MB or so; a broadcast keeps the pieces in order
    known = rows.join(F.broadcast(begin), ["file", "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, no, fresh, level, within = None, b"", 0, False, 0, False

        def end():
            """What the split leaves, if it ends inside a record."""
            return [(*at, no, BEGIN if fresh else MIDDLE, held.decode())] if held else []

        for split, text, row in runs(batches, "}"):
            out = []
            if at != split:
                if at is not None:
                    out += end()
                at, held, no, fresh = split, b"", 0, False
                within, level = row["within"], row["depth"]
            raw, base = text.encode(), level
            depth, within = structure(np.frombuffer(raw, np.uint8), within)
            depth = depth + base
            last = np.concatenate(([base], depth[:-1]))
            level = int(depth[-1])
            starts, stops = np.flatnonzero((depth == 2) & (last == 1)), np.flatnonzero((depth == 1) & (last == 2)) + 1
            if base >= 2:  # the text begins inside a record
                held += raw[: stops[0]] if len(stops) else raw
                if len(stops):
                    out.append((*at, no, WHOLE if fresh else END, held.decode()))
                    held, no, fresh, stops = b"", no + 1, False, stops[1:]
            for a, b in zip(starts, stops):
                out.append((*at, no, WHOLE, raw[a:b].decode()))
                no += 1
            if len(starts) > len(stops):
                held, fresh = raw[starts[-1] :], True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=_SCHEMA)
        if at is not None and (rest := end()):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rest)], schema=_SCHEMA)

    return joined(known.mapInArrow(run, _OUT))
