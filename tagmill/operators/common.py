"""Helpers that keep plans safe at scale: size checks, hot keys, reproducible order."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Rows that may be brought to the driver or shipped to every task. Above it, callers join.
SMALL_ROWS = 50_000


def small_rows(df: DataFrame, limit: int = SMALL_ROWS) -> list | None:
    """The rows of a table if it has at most ``limit``, else None. Never reads more."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def barrier_udf(udf):
    """An Arrow function the optimizer leaves where it is. It may otherwise be merged into the
    expressions that use its result, and then be evaluated once per use or not be found."""
    return udf.asNondeterministic()


def explode_rows(df: DataFrame, keep: list, array, name: str = "x", pos: str | None = None) -> DataFrame:
    """One row per array element. A plain explode makes the optimizer infer a filter on the
    array's size and push it down, computing the array's whole expression a second time."""
    exploded = F.posexplode_outer(array).alias(pos, name) if pos else F.explode_outer(array).alias(name)
    return df.select(*keep, exploded).where(F.col(name).isNotNull())


def order_key(id_col, seed: int = 42) -> Column:
    """Reproducible pseudo-random order of ids, the same in every engine with md5."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or below the warehouse where that is unset: both
    are shared by driver and executors. Never a folder of one machine on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    root = root or spark.conf.get("spark.sql.warehouse.dir", None)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/_tagmill/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: later uses do not recompute the plan,
    and a lost executor costs only its own tasks."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame) -> str:
    """Write to a new shared folder; its path."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete what ``write_table`` wrote, once no later job reads it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def with_row_key(df: DataFrame) -> DataFrame:
    """The table, written out, with a unique ``_row``: ids given by callers may repeat."""
    return materialize(df.withColumn("_row", F.monotonically_increasing_id()))


def checked_join(rows: DataFrame, table: DataFrame, key, how: str = "left") -> DataFrame:
    """Left or inner join to a table with unique ``key`` that is usually small.

    The table is written out and counted: up to SMALL_ROWS rows it is broadcast, so ``rows``
    are not shuffled; beyond it the join splits hot keys from the rest.
    """
    table = materialize(table)
    if table.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return rows.join(F.broadcast(table), key, how)
    if isinstance(key, list):
        return rows.join(table, key, how)
    joined = lookup_join(rows, table.withColumn("_found", F.lit(True)), key)
    return (joined.where("_found") if how == "inner" else joined).drop("_found")


def lookup_join(rows: DataFrame, table: DataFrame, key: str, hot_share: float = 1e-4) -> DataFrame:
    """Left join of skewed ``rows`` to a ``table`` with unique ``key``.

    Keys with more than ``hot_share`` of all rows are at most 1 / hot_share by count, so
    their part of the table is small enough to broadcast whatever the data size. The other
    keys are each rare, so a plain shuffle join spreads them evenly.
    """
    rows, table = materialize(rows), materialize(table)
    empty, rows = rows.where(F.col(key).isNull()), rows.where(F.col(key).isNotNull())
    counts = rows.groupBy(key).count()
    total = rows.count()
    hot = counts.where(F.col("count") > F.lit(total * hot_share)).select(key, F.lit(True).alias("_hot"))
    hot = F.broadcast(materialize(hot))
    marked = rows.join(hot, key, "left")
    hot_table = table.join(hot, key, "left_semi")
    left = marked.where("_hot").drop("_hot").join(F.broadcast(hot_table), key, "left")
    rest = marked.where("_hot is null").drop("_hot").join(table, key, "left")
    # NULL matches nothing, so those rows need no join and stay where they are
    absent = [F.lit(None).cast(t.dataType).alias(t.name) for t in table.schema if t.name != key]
    return left.unionByName(rest).unionByName(empty.select("*", *absent))
