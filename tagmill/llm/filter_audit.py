"""How filters interact: what each of them removes in every order, from counts of failure patterns.

Each document fails a subset of five filters. Counted per part (and per label), the subsets fill a
2 x 2 x 2 x 2 x 2 tensor, one axis a filter, index 1 for failing it. What a filter sees at any place of
any order is a contraction of that tensor: along each axis the vector (1, 0) takes those that pass, (0, 1)
those that fail and (1, 1) all of them. So documents are read once, whatever the number of orders.
"""

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tagmill.functions.let import let

FILTERS = "ABCDE"
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
# Rows without an id are dealt out by so many salts, since they meet no label.
_SALTS = 1024


def orders() -> list[tuple[str, int]]:
    """All (order, step), orders by letter."""
    return [("".join(p), s) for p in permutations(FILTERS) for s in range(1, len(FILTERS) + 1)]


def selectors() -> dict[str, np.ndarray]:
    """For each kind of count and each (order, step) the vector along every axis: (600, 5, 2)."""
    out = {name: [] for name in ("kept", "removed", "fails", "unique")}
    for order, step in orders():
        before, own = set(order[: step - 1]), order[step - 1]
        out["kept"].append([PASS if f in before or f == own else ALL for f in FILTERS])
        out["removed"].append([FAIL if f == own else PASS if f in before else ALL for f in FILTERS])
        out["fails"].append([FAIL if f == own else ALL for f in FILTERS])
        out["unique"].append([FAIL if f == own else PASS for f in FILTERS])
    return {k: np.array(v, np.int64) for k, v in out.items()}


def contract(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The tensor summed over what ``chosen`` (n, 5, 2) takes along its axes."""
    a, b, c, d, e = (chosen[:, i] for i in range(5))
    part = np.einsum("abcde,re->rabcd", tensor, e)
    part = np.einsum("rabcd,rd->rabc", part, d)
    part = np.einsum("rabc,rc->rab", part, c)
    return np.einsum("rab,ra,rb->r", part, a, b)


def audit_counts(total: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS for every (order, step) from counts by failure pattern; bit i of a pattern is filter i."""
    # C order puts the first axis at the highest bit, so the pattern's bits are reversed
    shape = lambda v: np.asarray(v, np.int64).reshape((2,) * 5).transpose(4, 3, 2, 1, 0)
    total, good, toxic = shape(total), shape(good), shape(toxic)
    s = selectors()
    removed = contract(total, s["removed"])
    own = np.array([FILTERS.index(order[step - 1]) for order, step in orders()])
    shapley = np.zeros(len(FILTERS), np.int64)
    np.add.at(shapley, own, removed)
    return {
        "kept": contract(total, s["kept"]), "removed": removed, "redundant": contract(total, s["fails"]) - removed, "unique_fails": contract(total, s["unique"]),
        "good_lost": contract(good, s["removed"]), "toxic_lost": contract(toxic, s["removed"]), "shapley": shapley[own],
    }


def failures(text: Column) -> Column:
    """Bits 0 to 3: the text (not null) fails A (under 100 words), B (100 * distinct words < 80 *
    words), C (100 * capitals A-Z > 10 * code points), D (holds one of ``#$%&*|``)."""

    def bits(t, found) -> Column:
        n = F.size(found)
        capitals = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
        special = F.length(F.translate(t, "#$%&*|", "")) < F.length(t)
        flags = [n < 100, 100 * F.size(F.array_distinct(found)).cast("long") < 80 * n.cast("long"), 100 * capitals.cast("long") > 10 * F.length(t).cast("long"), special]
        return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(flags)), F.lit(0))

    words = lambda t: F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    return let(lambda t: let(lambda found: bits(t, found), words(t)), text)


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``pattern`` (bit i: fails filter i), ``n, good, toxic``: documents by what they fail.

    Only ids, digests and patterns are shuffled. Documents are counted per text and part before
    texts are compared across the table, so a text that a third of the rows share is a few
    rows by then.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), failures(text).alias("fails"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.when(F.col("doc_id").isNull(), F.floor(F.rand(7) * _SALTS).cast("int")).otherwise(F.lit(0)).alias("salt"),
    )
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"),
    )
    # rows without an id meet no label, whatever their salt
    known = known.select(F.col("id").alias("known"), F.lit(0).alias("known_salt"), "good", "toxic")
    joined = rows.join(known, (F.col("id") == F.col("known")) & (F.col("salt") == F.col("known_salt")), "left").fillna(0, ["good", "toxic"])
    each = joined.groupBy("id", "salt", "part", "fails", "digest", "good", "toxic").agg(F.count("*").alias("n"))
    # rows of the smallest id of a text pass E; ids are distinct here, so the smallest brings its count
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    none = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(F.lit(0)))
    by_text = each.groupBy("digest", "part", "fails", "good", "toxic").agg(F.sum("n").alias("n"), first.alias("first"), none.alias("none"))
    return _by_pattern(by_text)


def _by_pattern(by_text: DataFrame) -> DataFrame:
    least = F.min("first.id").over(Window.partitionBy("digest"))
    original = F.col("none") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    split = by_text.withColumn("least", least).withColumn("original", original)
    e = 1 << FILTERS.index("E")
    both = F.explode(F.array(F.struct(F.col("fails").alias("pattern"), F.col("original").alias("m")), F.struct((F.col("fails") + e).alias("pattern"), (F.col("n") - F.col("original")).alias("m"))))
    counted = split.select("part", "good", "toxic", both.alias("c")).where("c.m > 0")
    return counted.groupBy("part", F.col("c.pattern").alias("pattern")).agg(
        F.sum("c.m").alias("n"), F.sum(F.col("c.m") * F.col("good")).alias("good"), F.sum(F.col("c.m") * F.col("toxic")).alias("toxic")
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per ``part`` (language), ``filter_order`` (120) and ``step`` (1 to 5) with COUNTS.

    ``docs`` has doc_id, text, lang; ``labels`` doc_id, quality, toxic. A null text counts as
    empty, a null language as the empty string. A document fails E if a row with a smaller id has the same
    text anywhere in the table; rows without an id fail it never and make none fail. Each row counts,
    repeated ones too (equal ids do not make each other fail). A document has a label if any
    of its label rows says so. An empty table gives an empty one; other columns are ignored.
    """
    patterns = failure_counts(docs, labels)
    # at most 32 entries a part
    per_part = patterns.groupBy("part").agg(F.collect_list(F.struct("pattern", "n", "good", "toxic")).alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = orders()
        names, steps = [o for o, _ in places], [s for _, s in places]
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = np.zeros((3, 32), np.int64)
                for c in counts:
                    t[:, c["pattern"]] += c["n"], c["good"], c["toxic"]
                out = audit_counts(*t)
                columns = [pa.array([part] * len(places), pa.string()), pa.array(names, pa.string()), pa.array(steps, pa.int32()), *[pa.array(out[c], pa.int64()) for c in COUNTS]]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *COUNTS])

    return per_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
