"""Exact order statistics per group, without holding a group's values anywhere.

Values become integers of the same order. Counts by their highest 16 bits tell in which range each
wanted rank lies; only that range is counted by its next 16 bits, and so on. After four rounds a
range is a single value.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize

DIGIT = 16  # bits of a round


def order_bits(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles: -0.0 as 0.0, not-a-number last."""
    values = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = values.view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def value_counts(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """``_g`` (struct of ``by``), ``_v``, ``_key`` (its order bits) and ``_n`` of the column's distinct values."""
    group = F.struct(*[F.col(f"`{c}`") for c in by] or [F.lit(1).alias("one")])
    seen = df.where(F.col(column).isNotNull()).groupBy(group.alias("_g"), F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = order_bits(batch.column("_v").to_numpy(zero_copy_only=False).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], [*batch.schema.names, "_key"])

    kind = seen.schema["_g"].dataType.simpleString()
    return materialize(seen.mapInArrow(run, f"_g {kind}, _v double, _n bigint, _key bigint"))


def select_ranks(counts: DataFrame, ranks: DataFrame) -> DataFrame:
    """``ranks`` (``_g``, ``_rank`` from 0, and others) with ``_value``, the group's value of that rank."""
    open_ranks = ranks.withColumns({"_left": F.col("_rank"), "_prefix": F.lit(0).cast("long")})
    for shift in range(64 - DIGIT, -1, -DIGIT):
        own, parent = counts, F.lit(0).cast("long")
        if shift < 64 - DIGIT:  # only the ranges that hold a wanted rank
            parent = F.shiftright("_key", shift + DIGIT)
            wanted = open_ranks.select("_g", "_prefix").distinct()
            own = counts.withColumn("_prefix", parent).join(wanted, ["_g", "_prefix"], "left_semi")
            parent = F.col("_prefix")
        ranges = own.groupBy("_g", parent.alias("_prefix"), F.shiftright("_key", shift).alias("_digit")).agg(F.sum("_n").alias("_n"), F.first("_v").alias("_value"))
        # at most 2^16 rows of a group and range
        upto = F.sum("_n").over(Window.partitionBy("_g", "_prefix").orderBy("_digit"))
        placed = ranges.withColumn("_before", upto - F.col("_n"))
        found = open_ranks.drop("_value").join(placed, ["_g", "_prefix"]).where("_left >= _before and _left < _before + _n")
        open_ranks = materialize(found.select(*ranks.columns, (F.col("_left") - F.col("_before")).alias("_left"), F.col("_digit").alias("_prefix"), "_value"))
    return open_ranks.select(*ranks.columns, "_value")


def percentiles(df: DataFrame, column: str, points: dict[str, float], by: list[str] = ()) -> DataFrame:
    """``by``, ``n``, ``mean``, ``min``, ``max`` and a column per point: exact percentiles with linear
    interpolation over all non-null values. Groups without a value have no row."""
    by = list(by)
    counts = value_counts(df, column, by)
    totals = materialize(counts.groupBy("_g").agg(
        F.sum("_n").alias("n"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"),
    ))
    spot = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    sides = [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), f(spot(p)).cast("long").alias("_rank")) for name, p in points.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    ranks = totals.select("_g", F.explode(F.array(*sides)).alias("r")).select("_g", "r.name", "r.side", "r._rank")
    found = select_ranks(counts, ranks)
    at = lambda name, side: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("_value")))
    wide = found.groupBy("_g").agg(*[at(name, side).alias(f"_{side}_{name}") for name in points for side in ("low", "high")])
    share = lambda p: spot(p) - F.floor(spot(p))

    def between(name, p):
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        return F.when(low == high, low).otherwise(low + share(p) * (high - low)).alias(name)

    return totals.join(wide, "_g").select(*[F.col(f"_g.`{c}`").alias(c) for c in by], "n", "mean", "min", "max", *[between(*x) for x in points.items()])
