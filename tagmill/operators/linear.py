"""Linear sequence tagger: feature weights per state plus transition weights.

Training is a linear-chain conditional random field (``chain``). Scoring takes any weight table,
imported ones included.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .chain import fit_chain
from .common import explode_rows, lookup_join, with_row_key
from .features import feature_strings
from .hmm import decode, decode_scored, hashed
from .sparse import MODEL_BYTES, sparse_rows

INTERCEPT = "(intercept)"


def fit_linear_tagger(train: DataFrame, c1: float = 0.1, c2: float = 0.1, max_iter: int = 100, **options) -> dict[str, DataFrame]:
    """``train`` has ``labels`` and ``features``; returns state(feature, state, weight) and
    trans(prev, state, weight) of a linear-chain conditional random field, and its ``losses``."""
    return fit_chain(train, feature_strings(train), c1, c2, max_iter, **options)


def _matrices(weights: dict[str, DataFrame]):
    trans_rows = weights["trans"].collect()
    states = sorted({r["state"] for r in trans_rows} | {r["prev"] for r in trans_rows})
    index = {s: i for i, s in enumerate(states)}
    trans = np.zeros((len(states), len(states)))
    for r in trans_rows:
        trans[index[r["prev"]], index[r["state"]]] = r["weight"]
    return states, index, trans


def state_vector(table: DataFrame, states: list[str]) -> np.ndarray:
    """The weights of the intercept, 0 where there is none."""
    out = dict.fromkeys(states, 0.0)
    out |= {r["state"]: r["weight"] for r in table.where(F.col("feature") == INTERCEPT).collect()}
    return np.array([out[s] for s in states])


def weighted_features(table: DataFrame, df: DataFrame) -> Column:
    """Feature strings of ``df`` of those features that have a weight for some value; others add nothing."""
    seen = table.select(F.split_part("feature", F.lit("="), F.lit(1)).alias("f")).distinct()
    fields = df.schema["features"].dataType.elementType.names
    named = {r["f"] for r in seen.where(F.col("f").isin(fields)).collect()}
    return feature_strings(df, [f for f in fields if f in named])


def tag_linear(
    df: DataFrame, weights: dict[str, DataFrame], pred: str = "pred",
    model_bytes: int = MODEL_BYTES,
) -> DataFrame:
    """Add the best label sequence by summed weights of rows with ``features``, which are
    dropped.

    A weight table of at most ``model_bytes`` travels to the tasks as sparse rows; a larger one is
    joined. The scorer is a step of its own rather than a column function, so that the costly
    feature expression stays in one place.
    """
    df = df if pred not in df.columns else df.drop(pred)
    states, _, trans = _matrices(weights)
    start = np.zeros(len(states))
    intercept = state_vector(weights["state"], states)
    named = weights["state"].where(F.col("feature") != INTERCEPT)
    table = sparse_rows(named, "feature", "weight", states, model_bytes)
    words = weighted_features(named, df)
    if table is None:
        vectors = named.groupBy("feature").pivot("state", states).agg(F.first("weight"))
        df = with_row_key(df.withColumn("_ws", words).drop("features"))
        long = explode_rows(df, ["_row"], "_ws", "_w", "pos").select("_row", "pos", F.explode("_w").alias("feature"))
        summed = lookup_join(long, vectors, "feature").groupBy("_row", "pos").agg(
            *[(F.sum(F.coalesce(F.col(f"`{s}`"), F.lit(0.0))) + float(intercept[i])).alias(s) for i, s in enumerate(states)]
        )
        scored = summed.select("_row", "pos", F.array(*[F.col(f"`{s}`") for s in states]).alias("e"))
        return decode_scored(df.drop("_ws"), scored, start, trans, states, pred)
    shared = df.sparkSession.sparkContext.broadcast((table, intercept, start, trans, states))

    def score(batch: pa.RecordBatch) -> pa.Array:
        known, base, first, move, names = shared.value
        obs = batch.column("_obs")
        lengths = np.asarray(pa.compute.list_value_length(obs).fill_null(0))
        per_token = obs.flatten()
        sizes = np.asarray(pa.compute.list_value_length(per_token))
        flat, ends = per_token.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)

        def scores(a: int, b: int) -> np.ndarray:
            lo, hi = (ends[a] - sizes[a], ends[b - 1]) if b > a else (0, 0)
            return known.summed(flat[lo:hi], np.repeat(np.arange(b - a), sizes[a:b]), b - a, base)

        return decode(scores, lengths, first, move, names)

    def viterbi(batches):
        for batch in batches:
            columns = [batch.column(c) for c in kept] + [score(batch)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, pred])

    kept = [c for c in df.columns if c != "features"]
    out = df.select(*kept).schema.add(pred, T.ArrayType(T.StringType()))
    return df.select(*kept, F.transform(words, hashed).alias("_obs")).mapInArrow(viterbi, out)


def top_weights(weights: DataFrame, k: int, prefix: list[str] | None = None) -> DataFrame:
    """The k weights of largest size, optionally of features with certain prefixes."""
    if prefix:
        test = F.lit(False)
        for p in prefix:
            test = test | F.startswith("feature", F.lit(p))
        weights = weights.where(test)
    return weights.orderBy(F.desc(F.abs("weight")), *[c for c in weights.columns if c != "weight"]).limit(k)
