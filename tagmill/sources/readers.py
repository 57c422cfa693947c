"""Readers. Every schema is fixed; nothing is inferred from the data."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.fixed import SEPARATOR
from . import schemas, splits


def read_samples(spark: SparkSession, path: str, schema: str = schemas.SAMPLES) -> DataFrame:
    """Raw or tagged samples; a missing path is an error at once."""
    return spark.read.schema(schema).parquet(path)


def read_samples_csv(spark: SparkSession, path: str) -> DataFrame:
    """The CSV twin, whose record column is JSON text or empty."""
    text = schemas.SAMPLES.replace(schemas.PII, "string")
    df = spark.read.schema(text).option("multiLine", True).option("escape", '"').csv(path, header=True)
    return df.withColumn("pii_data", F.from_json("pii_data", schemas.PII))


def read_annotation_export(spark: SparkSession, path: str) -> DataFrame:
    """Nested task export, one JSON array a file. Files are split among tasks inside the array.
    ``completed_by`` may be an object or a number: it is kept as text."""
    rows = splits.json_array(spark, path)
    return rows.select(F.from_json("text", schemas.ANNOTATION_TASKS).alias("r")).select("r.*")


def read_metrics(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """The metrics table; an error when read if a (model, dataset) has two rows for the same ``keys``,
    which two writers of different layouts may leave."""
    rows = spark.read.schema(f"{schema}, model string, dataset string").format(fmt).load(path)
    twice = rows.groupBy("model", "dataset", *keys).agg(F.count("*").alias("n")).where("n > 1")
    worst = twice.agg(F.max(F.struct("model", "dataset", *keys)).alias("w")).select("w").scalar()
    return rows.where(F.when(F.coalesce(worst["model"].isNotNull(), F.lit(False)), F.raise_error(F.concat(F.lit("double metrics rows of "), F.to_json(worst)))).otherwise(F.lit(True)))


def read_annotation_sheet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A sheet as text cells; blank ones are empty strings."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).option("escape", '"').option("multiLine", True).csv(path, header=True)
    return rows.na.fill("")


def read_round1(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(schemas.ROUND1).option("multiLine", True).json(path)
    return df.select(F.explode("annotations").alias("a")).select("a.*")


def read_term_list(spark: SparkSession, path: str) -> DataFrame:
    """One value per line, trimmed, blank lines dropped."""
    trimmed = F.regexp_replace("value", r"^\s+|\s+$", "")
    return spark.read.text(path).select(trimmed.alias("value")).where("value <> ''")


def read_log_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Request blocks of log files, cut at runs of 50 or more '='. Files are split among tasks
    however large they are; blocks that two splits share are put together."""
    rows = splits.split_by(spark, path, SEPARATOR)
    block = F.regexp_replace("text", r"^\s+|\s+$", "")
    return rows.select("file", block.alias("block")).where(F.col("block").contains("Intercepted:"))


def read_id_reference(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ID_REFERENCE).csv(path, header=True)


def read_loadtest(spark: SparkSession, path: str) -> DataFrame:
    """Load-test samples. Lines that do not start with a time stamp (shell prompt, header)
    are no data."""
    lines = spark.read.text(path).where(F.rlike("value", F.lit(r"^\d+,")))
    row = F.from_csv("value", F.lit(schemas.LOADTEST.replace("bigint", "long")), {"mode": "PERMISSIVE"})
    return lines.select(row.alias("r")).select("r.*")


def read_latency_list(spark: SparkSession, path: str) -> DataFrame:
    """One latency per line; other lines are skipped."""
    return (
        spark.read.text(path)
        .select(F.col("value").try_cast("double").alias("latency_ms"))
        .where("latency_ms is not null")
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAYLOADS).option("multiLine", True).json(path)


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Term lists; an absent table gives empty lists."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], schemas.GAZETTEER)
    return spark.read.schema(schemas.GAZETTEER).parquet(path)


def read_hmm(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(ddl).parquet(f"{path}/{name}") for name, ddl in schemas.HMM.items()}
