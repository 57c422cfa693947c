"""Entity-level precision, recall and F1, with macro and micro rows.

True and predicted labels of a sample stand in one row, so entities are matched by array set
functions inside it; the only shuffle is of a few counters per partition.
"""

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed import ENTITY_TYPES
from ..functions.labels import entity_spans, key_type, span_keys
from ..functions.verdicts import f1, ratio
from .common import explode_rows


def _tagged_keys(keys, side: str):
    return F.transform(
        keys, lambda k: F.struct(key_type(k).alias("entity"), F.lit(side).alias("side"))
    )


def counts_from_keys(df: DataFrame, keys: list[str], tp: str, fp: str, fn: str) -> DataFrame:
    """Sum tp, fp, fn per entity from arrays of span keys in the rows."""
    hits = F.concat(_tagged_keys(tp, "tp"), _tagged_keys(fp, "fp"), _tagged_keys(fn, "fn"))
    return (
        explode_rows(df, keys, hits, "h")
        .groupBy(*keys, "h.entity")
        .agg(*[F.count_if(F.col("h.side") == s).alias(s) for s in ("tp", "fp", "fn")])
    )


def match_entities(pairs: DataFrame, truth: str = "labels", pred: str = "pred", types=ENTITY_TYPES) -> DataFrame:
    """Add arrays tp, fp, fn of span keys (type|start|end)."""
    df = pairs.withColumns(
        {"_t": span_keys(entity_spans(truth, types)), "_p": span_keys(entity_spans(pred, types))}
    )
    return df.withColumns(
        {
            "tp": F.array_intersect("_t", "_p"),
            "fp": F.array_except("_p", "_t"),
            "fn": F.array_except("_t", "_p"),
        }
    ).drop("_t", "_p")


def entity_counts(pairs: DataFrame, keys: list[str], truth="labels", pred="pred", types=ENTITY_TYPES) -> DataFrame:
    return counts_from_keys(match_entities(pairs, truth, pred, types), keys, "tp", "fp", "fn")


def scores(counts: DataFrame) -> DataFrame:
    """precision, recall, f1, support from tp, fp, fn; 0 where a denominator is 0."""
    return (
        counts.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp")))
        .withColumn("recall", ratio("tp", F.col("tp") + F.col("fn")))
        .withColumn("f1", f1("precision", "recall"))
        .withColumn("support", F.col("tp") + F.col("fn"))
    )


def with_macro_micro(entity_scores: DataFrame, keys: list[str], digits: int = 6, fixed_types: int | None = None) -> DataFrame:
    """Entity rows plus ``_macro`` and ``_micro`` rows, in one aggregation.

    Macro is the mean over the entity types seen in truth or prediction, or over
    ``fixed_types`` of them, a type never seen counting as 0.
    """
    c = F.col
    both = entity_scores.withColumn("entity", F.explode(F.array("entity", F.lit("_total"))))
    mean = (lambda x: F.sum(x) / F.lit(fixed_types)) if fixed_types else F.avg
    agg = both.groupBy(*keys, "entity").agg(
        *[F.sum(x).alias(x) for x in ("tp", "fp", "fn")],
        *[F.avg(x).alias(x) for x in ("precision", "recall", "f1")],
        *[mean(x).alias(f"_m_{x}") for x in ("precision", "recall", "f1")],
    )
    micro_p, micro_r = ratio("tp", c("tp") + c("fp")), ratio("tp", c("tp") + c("fn"))

    def row(name, p, r, f):
        return F.struct(
            name.alias("entity"),
            F.round(p, digits).alias("precision"),
            F.round(r, digits).alias("recall"),
            F.round(f, digits).alias("f1"),
        )

    own = F.array(row(c("entity"), c("precision"), c("recall"), c("f1")))
    total = F.array(
        row(F.lit("_macro"), c("_m_precision"), c("_m_recall"), c("_m_f1")),
        row(F.lit("_micro"), micro_p, micro_r, f1(micro_p, micro_r)),
    )
    return agg.select(
        *keys,
        (c("tp") + c("fn")).alias("support"),
        "tp",
        "fp",
        "fn",
        F.explode_outer(F.when(c("entity") == "_total", total).otherwise(own)).alias("m"),
    ).select(*keys, "m.*", "support", "tp", "fp", "fn")


def entity_metrics(pairs: DataFrame, keys: list[str] = (), truth="labels", pred="pred", types=ENTITY_TYPES, digits=6) -> DataFrame:
    """Metrics table of rows that hold true and predicted labels, per ``keys``."""
    keys = list(keys)
    return with_macro_micro(scores(entity_counts(pairs, keys, truth, pred, types)), keys, digits)


def join_predictions(truth: DataFrame, predictions: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Truth rows beside predictions that come as a table of their own."""
    return truth.join(predictions, id_col)


def misclassified_examples(
    pairs: DataFrame, n: int = 3, max_len: int = 25, id_col: str = "sample_id", truth="labels", pred="pred"
) -> DataFrame:
    """The first n samples of at most max_len tokens with a wrong or missed entity."""
    return (
        match_entities(pairs.where(F.size("tokens") <= max_len), truth, pred)
        .where((F.size("fp") > 0) | (F.size("fn") > 0))
        .select(
            id_col,
            F.array_join("tokens", " ").alias("text"),
            F.array_join("fn", ",").alias("missed"),
            F.array_join("fp", ",").alias("wrong"),
        )
        .orderBy(id_col)
        .limit(n)
    )


def macro_consistency(metrics: DataFrame, keys: list[str], n_types: int = 5, tolerance: float = 1e-4) -> DataFrame:
    """Whether the macro F1 equals the sum of the entity F1 over ``n_types``."""
    entity = ~F.startswith("entity", F.lit("_"))
    return (
        metrics.groupBy(*keys)
        .agg(
            F.sum(F.when(entity, F.col("f1"))).alias("s"),
            F.max(F.when(F.col("entity") == "_macro", F.col("f1"))).alias("macro_f1"),
        )
        .select(
            *keys,
            F.round(F.col("s") / n_types, 6).alias("mean_f1"),
            "macro_f1",
            (F.abs(F.col("s") / n_types - F.col("macro_f1")) < tolerance).alias("consistent"),
        )
    )
