"""Seeded order, stratified splits and samples, unions of sources.

A stratum may hold a third of all rows, so none is ever ranked in one task. Rows are ordered
by the md5 of seed and id; counting rows per leading digits of that key shows in which small
range each cut falls, and only that range is sorted. The wide rows are then compared with one
key per stratum and cut, and never shuffled.
"""

from pyspark.sql import DataFrame, Window, functions as F

from .common import checked_join, order_key


def shuffle_seeded(df: DataFrame, id_col: str = "sample_id", seed: int = 42) -> DataFrame:
    return df.orderBy(order_key(id_col, seed), id_col)


def union_sources(tables: dict[str, DataFrame]) -> DataFrame:
    """Union by name with missing columns as NULL, and the name of the source."""
    out = None
    for name, df in tables.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def _cut_keys(df: DataFrame, by: str, key, targets, digits: int) -> DataFrame:
    """(by, key_1, key_2, ...): the key of the row at each target rank within a stratum.

    ``targets`` maps the stratum's row count to the target ranks; a rank of 0 gives NULL.
    """
    keyed = df.select(by, key.alias("_key")).withColumn("_range", F.left("_key", F.lit(digits)))
    order = Window.partitionBy(by).orderBy("_range")
    ranges = (
        keyed.groupBy(by, "_range")
        .agg(F.count("*").alias("_n"))
        .withColumns(
            {
                "_before": F.coalesce(
                    F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
                ),
                "_all": F.sum("_n").over(Window.partitionBy(by)),
            }
        )
    )
    ranks = targets(F.col("_all"))
    bounds = ranges.select(
        by, "_range", "_n", "_before", F.posexplode(F.array(*ranks)).alias("_cut", "_rank")
    ).where("_before < _rank and _rank <= _before + _n")
    bounds = bounds.select(by, "_range", "_cut", (F.col("_rank") - F.col("_before")).alias("_need"))
    # At most one range per stratum and cut: few rows, whatever the number of samples.
    inside = Window.partitionBy(by, "_range", "_cut").orderBy("_key")
    return (
        checked_join(keyed, bounds, [by, "_range"], "inner")
        .withColumn("_rn", F.row_number().over(inside))
        .where("_rn = _need")
        .groupBy(by)
        .agg(*[F.max(F.when(F.col("_cut") == i, F.col("_key"))).alias(f"_key_{i}") for i in range(len(ranks))])
    )


def stratified_split(
    df: DataFrame,
    by: str = "format",
    shares=(("train", 0.8), ("val", 0.1), ("test", 0.1)),
    id_col: str = "sample_id",
    seed: int = 42,
    digits: int = 4,
) -> DataFrame:
    """Add ``split``: exact shares within each stratum, rounded to whole rows."""
    names = [n for n, _ in shares]
    cumulative, total = [], 0.0
    for _, share in shares[:-1]:
        total += share
        cumulative.append(round(total, 9))
    key = order_key(id_col, seed)
    cuts = _cut_keys(
        df, by, key, lambda n: [F.floor(n * c + 0.5).cast("long") for c in cumulative], digits
    )
    out = None
    for i, name in enumerate(names[:-1]):
        test = F.col("_k") <= F.col(f"_key_{i}")
        out = F.when(test, name) if out is None else out.when(test, name)
    return (
        checked_join(df.withColumn("_k", key), cuts, by)
        .withColumn("split", out.otherwise(names[-1]))
        .drop("_k", *[f"_key_{i}" for i in range(len(names) - 1)])
    )


def stratified_sample(
    df: DataFrame, share: float, by: str = "format", id_col: str = "sample_id", seed: int = 42, digits: int = 4
) -> DataFrame:
    """The same share of rows from every stratum, exact to the row."""
    kept = stratified_split(df, by, (("kept", share), ("rest", 1 - share)), id_col, seed, digits)
    return kept.where("split = 'kept'").drop("split")


def split_crosstab(df: DataFrame, by: str = "format", names=("train", "val", "test")) -> DataFrame:
    return df.groupBy(by).agg(
        *[F.count_if(F.col("split") == n).alias(n) for n in names], F.count("*").alias("total")
    )
