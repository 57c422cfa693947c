"""Annotation exports and sheets: tasks, spans, completeness, totals."""

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed import ENTITY_TYPES
from ..functions.text import sample_code
from .agreement import role_of_annotator, spans_to_bio


def annotation_rows(tasks: DataFrame, annotator_a: str, annotator_b: str) -> DataFrame:
    """Task export to one row per task and known annotator, with its label spans."""
    ann = tasks.select(
        F.col("id").alias("task_id"),
        "inner_id",
        F.coalesce("data.text", F.lit("")).alias("text"),
        F.coalesce("data.meta_format", F.lit("unknown")).alias("meta_format"),
        F.posexplode("annotations").alias("position", "ann"),
    )
    who = F.col("ann.completed_by")
    uid = F.coalesce(F.get_json_object(who, "$.id"), who)
    spans = F.transform(F.filter("ann.result", lambda r: r["type"] == "labels"), lambda r: r["value"])
    return (
        ann.withColumn("role", role_of_annotator(F.get_json_object(who, "$.email"), uid, annotator_a, annotator_b))
        .where("role is not null")
        .select("task_id", "inner_id", "text", "meta_format", "position", "role", F.coalesce(spans, F.expr("array()")).alias("spans"))
    )


def annotation_labels(tasks: DataFrame, annotator_a: str, annotator_b: str) -> DataFrame:
    """As above, with tokens and BIO labels."""
    return spans_to_bio(annotation_rows(tasks, annotator_a, annotator_b))


def annotation_completeness(tasks: DataFrame, count: str | None = None) -> DataFrame:
    """Tasks by number of annotations: of the array ``annotations``, or in a column ``count``."""
    n = F.col(count) if count else F.coalesce(F.array_size("annotations"), F.lit(0))
    return tasks.agg(
        F.count("*").alias("tasks"),
        F.count_if(n == 0).alias("zero"),
        F.count_if(n == 1).alias("one"),
        F.count_if(n >= 2).alias("two_or_more"),
    )


def annotation_entity_totals(annotations: DataFrame) -> DataFrame:
    """Annotated values per entity from columns that hold arrays of values."""
    size = lambda t: F.sum(F.coalesce(F.array_size(t), F.lit(0)))
    row = annotations.agg(*[size(t).alias(t) for t in ENTITY_TYPES])
    stack = ", ".join(f"'{t}', `{t}`" for t in ENTITY_TYPES)
    return row.select(F.expr(f"stack({len(ENTITY_TYPES)}, {stack}) as (entity, n)"))


def attach_text(annotations: DataFrame, holdout: DataFrame) -> DataFrame:
    """Payload and format of the annotated sample; without a payload the tokens are joined."""
    texts = holdout.select(
        "sample_id",
        F.coalesce(F.nullif(F.col("payload"), F.lit("")), F.array_join("tokens", " "), F.lit("")).alias("raw_text"),
        F.col("format").alias("_format"),
    )
    out = annotations.join(texts, "sample_id", "left")
    return out.withColumn("raw_text", F.coalesce("raw_text", F.lit(""))).withColumn(
        "format", F.coalesce("_format", "format", F.lit("unknown"))
    ).drop("_format")


def annotation_sheet(annotated: DataFrame, filled: bool = True) -> DataFrame:
    """The sheet an annotator fills in: values joined by `` || ``, or blank cells."""
    cell = lambda t: (
        F.coalesce(F.array_join(t, " || "), F.lit("")) if filled else F.lit("")
    ).alias(t)
    note = F.coalesce(F.col("note"), F.lit("")) if filled else F.lit("")
    return annotated.select(
        sample_code(F.col("sample_id")).alias("ID"),
        F.col("format").alias("Format"),
        F.col("raw_text").alias("Raw_Text"),
        *[cell(t) for t in ENTITY_TYPES],
        note.alias("Catatan"),
    )
