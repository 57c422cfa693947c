"""Writers."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def write_samples(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_samples_csv(df: DataFrame, path: str) -> None:
    """CSV twin: the record as JSON text, empty for negatives."""
    df.withColumn("pii_data", F.to_json("pii_data")).write.mode("overwrite").option("escape", '"').csv(
        path, header=True
    )


def write_metrics(metrics: DataFrame, path: str, fmt: str = "parquet", model: str = "", dataset: str = "", **tags: str) -> None:
    """Long metrics table, one partition per (model, dataset); other tags become columns.

    Writing a model's metrics on a set again replaces those rows only, however often a job is repeated.
    """
    keys = {"model": F.lit(model), "dataset": F.lit(dataset)}
    out = metrics.withColumns({k: F.lit(v) for k, v in tags.items()} | keys)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).format(fmt).save(path)


def write_gazetteer(gazetteer: DataFrame, path: str) -> None:
    gazetteer.write.mode("overwrite").parquet(path)


def write_hmm(model: dict[str, DataFrame], path: str) -> None:
    for name, table in model.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def write_annotation_export(tasks: DataFrame, path: str) -> None:
    """Task rows as nested JSON, one array a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            texts = [("[" if first and not i else ",") + t for i, t in enumerate(batch.column(0).to_pylist())]
            first = first and not texts
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"], pa.string())], ["value"])

    tasks.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_annotation_sheet(sheet: DataFrame, path: str) -> None:
    sheet.write.mode("overwrite").option("escape", '"').csv(path, header=True)


def write_payloads(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
