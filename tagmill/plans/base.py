"""Inputs of the registered queries, all derived by Spark from the given tables."""

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.labels import tag_regex
from ..operators.labeling import label_samples
from .payloads import damaged_nik, person_columns, render_payloads

# Bytes of a scan that one task reads at Spark's defaults.
SPLIT_BYTES = 128 << 20
# Rows that one task works on, about, and bytes per core below which a table is not counted for that.
TASK_ROWS, COUNTED_BYTES = 50_000, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One that is smaller than a split per core is dealt out evenly, since it would
    otherwise be read, and worked on, by one task; the more rows, the more tasks, so that what a task holds does
    not grow with the table. A larger one stays where its splits are."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    cores = spark.sparkContext.defaultParallelism
    if size >= cores * SPLIT_BYTES:
        return df
    return df.repartition(cores if size < cores * COUNTED_BYTES else max(cores, -(-df.count() // TASK_ROWS)))


# Rows of a table that one task of a stream works on, about.
STREAM_ROWS = 50_000


def stream(spark: SparkSession, sf_dir: str, name: str, deal: bool = False) -> DataFrame:
    """A given table as a file stream; with ``deal`` its rows are dealt out, to more tasks the more
    there are, since a few splits would otherwise be worked on by as few tasks."""
    given = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = spark.readStream.schema(given.schema).option("pathGlobFilter", f"{name}.parquet").parquet(os.fspath(sf_dir))
    if not deal:
        return df
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-given.count() // STREAM_ROWS)))


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person per customer; the nation is one of the places."""
    k = F.col("c_custkey")
    return (
        table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(k.alias("sample_id"), *person_columns(k, F.col("n_name")))
    )


def niks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National IDs, some damaged."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("sample_id"), damaged_nik(k).alias("nik"))


def samples(spark: SparkSession, sf_dir: str, set_name: str = "main") -> DataFrame:
    return render_payloads(people(spark, sf_dir), set_name)


def tagged(spark: SparkSession, sf_dir: str, set_name: str = "main") -> DataFrame:
    return label_samples(samples(spark, sf_dir, set_name))


def predicted(spark: SparkSession, sf_dir: str, set_name: str = "main") -> DataFrame:
    """Tagged samples with the pattern tagger's labels in ``pred``."""
    return tagged(spark, sf_dir, set_name).withColumn("pred", tag_regex("tokens"))


def annotator_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdout payloads labelled twice: annotator B misses places, cuts names short and takes
    job titles for places on some samples."""
    k = F.col("sample_id")
    second = F.transform(
        "labels",
        lambda l: F.when((k % 5 == 0) & F.endswith(l, F.lit("-LOKASI")), "O")
        .when((k % 7 == 1) & (l == "I-NAMA"), "O")
        .when((k % 11 == 2) & (l == "B-JABATAN"), "B-LOKASI")
        .when((k % 11 == 2) & (l == "I-JABATAN"), "I-LOKASI")
        .when((k % 13 == 3) & (l == "B-NAMA"), "O")
        .when((k % 13 == 3) & (l == "I-NAMA"), "B-NAMA")
        .otherwise(l),
    )
    return tagged(spark, sf_dir, "holdout").select(
        F.col("sample_id").alias("task_id"), "format", "tokens", F.col("labels").alias("labels_a"), second.alias("labels_b")
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_logs(people(spark, sf_dir))


def render_logs(persons: DataFrame) -> DataFrame:
    """Proxy logs, one text per person with one or two request blocks; every ninth ID is
    missed, and every eleventh block reports an ID nobody sent."""
    k = F.col("sample_id")
    line = "=" * 50
    body = F.concat(F.lit('Original body: {"nik":"'), F.col("nik"), F.lit('","ref":"1234567890123456"}\n'))
    hit = F.concat(F.lit("- NIK: "), F.col("nik"), F.lit(" -> "), F.substring("nik", 1, 6), F.lit("XXXXXXXXXX\n"))
    wrong = F.concat(F.lit("- NIK: 99"), F.substring("nik", 3, 14), F.lit(" -> 99XXXXXXXXXX\n"))
    timing = F.concat(
        F.lit("Total 1 masked | Time: "), (k % 40 + 1).cast("string"), F.lit("."), F.lpad((k * 7 % 100).cast("string"), 2, "0"), F.lit(" ms\n")
    )
    block = F.concat(
        F.lit(f"{line}\nIntercepted: POST /api/data\n"),
        body,
        F.when(k % 9 != 0, hit).otherwise(""),
        F.when(k % 11 == 0, wrong).otherwise(""),
        F.when(k % 6 != 0, timing).otherwise(""),
    )
    other = F.when(k % 4 == 0, F.lit(f"{line}==\nIntercepted: GET /health\nOriginal body: -\nTime: 1.5 ms\n")).otherwise("")
    return persons.select(k.alias("log_id"), F.concat(block, other).alias("value"))


def expected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDs that were sent: all but every thirteenth person's, and one per fifty nobody logged."""
    df = people(spark, sf_dir)
    sent = df.where("sample_id % 13 <> 0").select("nik")
    unsent = df.where("sample_id % 50 = 0").select(F.concat(F.lit("88"), F.substring("nik", 3, 14)).alias("nik"))
    return sent.union(unsent)
