"""Streams: detect and mask payloads, count detections per window, validate a log."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.labels import entity_spans, tag_regex
from ..functions.text import decoded_payload, tokenize
from ..operators.common import shared_folder
from ..operators.masking import DEFAULT_POLICY, mask_entities


def detect_and_mask(payloads: DataFrame, tagger=None, policy=DEFAULT_POLICY) -> DataFrame:
    """Stateless: works on a stream and on a table alike. ``tagger`` adds ``pred`` to rows with
    ``tokens``; the pattern tagger is the default."""
    df = payloads.withColumn("tokens", tokenize(decoded_payload("payload", "format")))
    df = tagger(df) if tagger else df.withColumn("pred", tag_regex("tokens"))
    df = mask_entities(df, labels="pred", policy=policy)
    return df.withColumn("entities", entity_spans("pred"))


def detection_counts(
    detections: DataFrame, time_col: str, by: str, value: str, window: str, slide: str | None = None,
    session: bool = False, late: str = "10 minutes",
) -> DataFrame:
    """Detections and latency per time window and entity; rows later than ``late`` are dropped.

    Tumbling by default, sliding with ``slide``, session windows with ``window`` as the gap.
    """
    span = F.session_window(time_col, window) if session else F.window(time_col, window, slide)
    return (
        detections.withWatermark(time_col, late)
        .groupBy(span.alias("w"), by)
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("maximum"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n", "total", "maximum")
    )


def run_to_files(stream: DataFrame, path: str | None = None, mode: str = "append") -> tuple[StreamingQuery, str]:
    """Process all there is and stop; results are files in the shared folder, so nothing is
    gathered on the driver and a restart goes on from the checkpoint."""
    path = path or shared_folder(stream.sparkSession)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{path}/out")
    )
    query.awaitTermination()
    return query, f"{path}/out"


# A time after all events; a row that bears it closes every window before it.
CLOSING_TIME = "2200-01-01 00:00:00"


def run_to_end(events: DataFrame, time_col: str, build) -> DataFrame:
    """All windows of a bounded stream, those still open at its end included.

    ``build`` makes the windowed counts from the events. The stream is run to the end of its
    input; then one row of a far later time is added and the same query goes on from its
    checkpoint, so that the watermark passes every window. Late rows are dropped as always.
    """
    spark = events.sparkSession
    path = shared_folder(spark)
    mark = spark.createDataFrame([], events.schema)
    mark.write.parquet(f"{path}/mark")
    marks = spark.readStream.schema(events.schema).parquet(f"{path}/mark")
    counts = build(events.unionByName(marks))
    run_to_files(counts, path)
    row = [F.lit(CLOSING_TIME if f.name == time_col else None).cast(f.dataType).alias(f.name) for f in events.schema]
    spark.range(1).select(*row).write.mode("append").parquet(f"{path}/mark")
    run_to_files(counts, path)
    return spark.read.schema(counts.schema).parquet(f"{path}/out").where(F.col("window_end") < F.lit(CLOSING_TIME).cast("timestamp"))
