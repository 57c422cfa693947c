"""Counts and shares of labels, groups, entities and IDs."""

from pyspark.sql import DataFrame, functions as F

from ..functions import nik
from ..functions.fixed import ENTITY_TYPES
from ..functions.let import let
from .common import explode_rows


def _share(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Add ``pct`` of the total (per group of ``by``); the input is already aggregated. Totals
    are summed and joined, so the groups themselves never meet in one task."""
    totals = df.groupBy(*(by or [])).agg(F.sum("n").alias("_total"))
    joined = df.join(totals, by) if by else df.join(F.broadcast(totals), F.lit(True))
    return joined.withColumn("pct", F.round(100 * F.col("n") / F.col("_total"), 6)).drop("_total")


def label_distribution(tagged: DataFrame, labels: str = "labels") -> DataFrame:
    counts = explode_rows(tagged, [], labels, "label").groupBy("label").agg(F.count("*").alias("n"))
    return _share(counts)


def group_distribution(df: DataFrame, *by: str) -> DataFrame:
    return _share(df.groupBy(*by).agg(F.count("*").alias("n")))


def entity_coverage(tagged: DataFrame, by: str | None = None, labels: str = "labels") -> DataFrame:
    """Samples with at least one B- label of each entity, overall or per group."""
    base = tagged.groupBy(*([by] if by else []))
    wide = base.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.array_contains(labels, f"B-{t}")).alias(t) for t in ENTITY_TYPES],
    )
    stack = ", ".join(f"'{t}', `{t}`" for t in ENTITY_TYPES)
    return wide.select(
        *([by] if by else []), "total", F.expr(f"stack({len(ENTITY_TYPES)}, {stack}) as (entity, n)")
    ).withColumn("rate", F.round(F.coalesce(F.try_divide(F.col("n"), F.col("total")), F.lit(0.0)), 6))


def example_per_group(df: DataFrame, by: str, id_col: str = "sample_id", width: int = 130) -> DataFrame:
    """The row with the lowest id of each group, payload cut for reading. Aggregates, so a
    large group is reduced before the shuffle."""
    return df.groupBy(by).agg(
        F.min(F.struct(id_col, F.left("payload", F.lit(width)).alias("example"))).alias("r")
    ).select(by, f"r.{id_col}", "r.example")


def nik_population(df: DataFrame, column: str = "nik") -> DataFrame:
    """Rows, valid IDs, distinct provinces and gender split in one pass."""
    v, parts = nik.validate(F.col(column)), nik.decode(F.col(column))
    base = df.select(v.alias("v"), parts.alias("p"))
    return base.agg(
        F.count("*").alias("n"),
        F.count_if("v.valid").alias("n_valid"),
        F.count_distinct(F.when(F.col("v.valid"), F.col("p.province_code"))).alias("provinces"),
        F.count_if(F.col("v.valid") & (F.col("v.gender") == "L")).alias("male"),
        F.count_if(F.col("v.valid") & (F.col("v.gender") == "P")).alias("female"),
    )


def top_provinces(df: DataFrame, column: str = "nik", k: int = 5) -> DataFrame:
    """The k provinces with most valid IDs; names are looked up after counting."""
    code = F.substring(column, 1, 2).try_cast("int")
    return (
        df.where(let(lambda n: nik.validate(n)["valid"], column))
        .groupBy(code.alias("code"))
        .agg(F.count("*").alias("n"))
        .select(nik.province_name(F.col("code")).alias("province"), "n")
        .orderBy(F.desc("n"), "province")
        .limit(k)
    )
