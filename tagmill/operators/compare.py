"""Compare taggers: robustness, paired tests, gaps between sets, rankings."""

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import align_labels, all_outside, any_begin_hit, any_entity
from ..functions.verdicts import gap_status, rate_marker, ratio, significance_stars

NON_PII = ["context_free_16digit", "near_pattern"]


def robustness_by_category(pairs: DataFrame, truth="labels", pred="pred", category="category", model="model") -> DataFrame:
    """Per model and category: samples wrongly marked, rightly marked, missed, with rates."""
    negative = all_outside(truth)
    hit = any_begin_hit(truth, pred)
    counts = pairs.groupBy(model, category).agg(
        F.count("*").alias("total"),
        F.count_if(negative & any_entity(pred)).alias("fp"),
        F.count_if(~negative & hit).alias("tp"),
        F.count_if(~negative & ~hit).alias("fn"),
    )
    kind = F.when(F.col(category).isin(NON_PII), "FP").otherwise("TP")
    rate = ratio(100 * F.when(kind == "FP", F.col("fp")).otherwise(F.col("tp")), F.col("total"))
    return (
        counts.withColumn("kind", kind)
        .withColumn("rate", F.round(rate, 6))
        .withColumn("marker", rate_marker("rate", "kind"))
    )


def robustness_score(by_category: DataFrame, model="model") -> DataFrame:
    """tp - fp over all categories, and with each count only where it is meant to be."""
    c = F.col
    return by_category.groupBy(model).agg(
        (F.sum("tp") - F.sum("fp")).alias("score_all"),
        (
            F.sum(F.when(c("kind") == "TP", c("tp")).otherwise(0))
            - F.sum(F.when(c("kind") == "FP", c("fp")).otherwise(0))
        ).alias("score_by_kind"),
        F.sum("tp").alias("tp"),
        F.sum("fp").alias("fp"),
    )


def all_labels_right(truth, pred) -> Column:
    return F.forall(align_labels(truth, pred), lambda p: p["a"] == p["b"])


def correctness(pairs: DataFrame, truth="labels", pred="pred", id_col="sample_id", model="model") -> DataFrame:
    return pairs.select(model, id_col, all_labels_right(truth, pred).alias("correct"))


def sample_accuracy(correct: DataFrame, model="model") -> DataFrame:
    return correct.groupBy(model).agg(
        F.count("*").alias("n"),
        F.count_if("correct").alias("n_correct"),
        F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"),
    )


def mcnemar_table(correct: DataFrame, model_pairs: list[tuple[str, str]], id_col="sample_id", model="model") -> DataFrame:
    """Both right, A only, B only, both wrong for each pair of models.

    One aggregation per sample over the models named, then one over samples.
    """
    names = sorted({m for p in model_pairs for m in p})
    wide = correct.where(F.col(model).isin(names)).groupBy(id_col).pivot(model, names).agg(F.first("correct"))
    return mcnemar_side_by_side(wide, model_pairs)


def right_side_by_side(df: DataFrame, names: list[str], truth="labels", keep: list[str] = ()) -> DataFrame:
    """A boolean per model from predictions ``pred_<name>`` in one row: are all labels right?"""
    return df.select(*keep, *[all_labels_right(truth, f"pred_{n}").alias(n) for n in names])


def mcnemar_side_by_side(wide: DataFrame, model_pairs: list[tuple[str, str]]) -> DataFrame:
    """The same from one row per sample with a boolean column per model; only counters are shuffled."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(a).alias("model_a"), F.lit(b).alias("model_b"),
                F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b"),
            )
            for a, b in model_pairs
        ]
    )
    c = F.col
    return (
        wide.select(F.explode(pairs).alias("p"))
        .where("p.a is not null and p.b is not null")
        .groupBy("p.model_a", "p.model_b")
        .agg(
            F.count_if(c("p.a") & c("p.b")).alias("both_correct"),
            F.count_if(c("p.a") & ~c("p.b")).alias("a_only"),
            F.count_if(~c("p.a") & c("p.b")).alias("b_only"),
            F.count_if(~c("p.a") & ~c("p.b")).alias("both_wrong"),
        )
    )


def _binomial_cdf(k: int, n: int) -> float:
    return sum(math.comb(n, i) for i in range(k + 1)) / 2.0**n if k >= 0 else 0.0


def _p_value(b: int, c: int, legacy: bool) -> float:
    n, m = b + c, min(b, c)
    if n == 0:
        return 1.0
    if n >= 25:
        return math.erfc(math.sqrt((abs(b - c) - 1) ** 2 / n / 2))
    tail = _binomial_cdf(m - 1 if legacy else m, n)
    return min(1.0, 2 * tail)


def mcnemar_stats(table: DataFrame, method: str = "exact") -> DataFrame:
    """Chi-square with continuity correction, p-value, stars and the better model.

    Below 25 disagreements the p-value is binomial: ``exact`` doubles the tail up to the
    smaller count, ``reference`` the tail just below it. One row per pair of models.
    """
    legacy = method == "reference"

    @F.arrow_udf("double")
    def p_value(b: pa.Array, c: pa.Array) -> pa.Array:
        return pa.array([_p_value(x, y, legacy) for x, y in zip(b.to_pylist(), c.to_pylist())], pa.float64())

    b, c = F.col("a_only"), F.col("b_only")
    n = b + c
    return (
        table.withColumn("n_disagreements", n)
        .withColumn("chi_square", F.coalesce(F.try_divide(F.pow(F.abs(b - c) - 1, 2), n), F.lit(0.0)))
        .withColumn("p_value", p_value("a_only", "b_only"))
        .withColumn("significance", F.when(n == 0, "No disagreement").otherwise(significance_stars("p_value")))
        .withColumn("better_model", F.when(b > c, F.col("model_a")).when(c > b, F.col("model_b")).otherwise("TIE"))
        .withColumn(
            "test_method",
            F.when(n == 0, "N/A").when(n < 25, "Exact binomial").otherwise("Asymptotic (continuity correction)"),
        )
    )


def test_holdout_gap(test: DataFrame, holdout: DataFrame, model="model") -> DataFrame:
    """Macro F1 on both sets, the gap (0 for a model without test metrics) and its reading."""
    pick = lambda df, name: df.where("entity = '_macro'").select(model, F.col("f1").alias(name))
    return (
        pick(holdout, "holdout_f1")
        .join(pick(test, "test_f1"), model, "left")
        .withColumn("test_f1", F.coalesce("test_f1", F.lit(0.0)))
        .withColumn("gap", F.round(F.col("test_f1") - F.col("holdout_f1"), 6))
        .withColumn("status", gap_status("gap"))
    )


def rank_models(df: DataFrame, by: str, model="model") -> DataFrame:
    """Rank by a score; one row per model, so the window is tiny."""
    return df.withColumn("rank", F.rank().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(by))))


def best_model(df: DataFrame, by: str, model="model") -> DataFrame:
    return df.agg(F.max_by(model, by).alias("model"), F.max(by).alias(by))


def model_entity_matrix(metrics: DataFrame, entities: list[str], model="model", value="f1") -> DataFrame:
    """One row per model, one column per entity and the macro mean; 0 where a type is unseen."""
    wide = metrics.groupBy(model).pivot("entity", entities + ["_macro"]).agg(F.first(value))
    return wide.select(
        model,
        *[F.coalesce(F.col(e), F.lit(0.0)).alias(e) for e in entities],
        F.coalesce(F.col("_macro"), F.lit(0.0)).alias("macro"),
    )


def metric_delta(metrics: DataFrame, new: str, baselines: list[str], model="model", value="f1") -> DataFrame:
    """Per entity, the new model's value minus each baseline's, and whether it is the best."""
    wide = metrics.groupBy("entity").pivot(model, [new] + baselines).agg(F.first(value))
    col = lambda m: F.coalesce(F.col(f"`{m}`"), F.lit(0.0))
    return wide.select(
        "entity",
        col(new).alias(new),
        *[F.round(col(new) - col(b), 6).alias(f"vs_{b}") for b in baselines],
        (col(new) >= F.greatest(col(new), *[col(b) for b in baselines])).alias("best"),
    )
