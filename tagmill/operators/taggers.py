"""Several taggers in one pass: each batch is decoded by every model, predictions side by side."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .hmm import _parameters, decode, hashed, observed, tag_hmm
from .linear import INTERCEPT, _matrices, state_vector, tag_linear
from .features import feature_strings
from .sparse import MODEL_BYTES, SparseRows, sparse_rows


@dataclass
class ChainModel:
    """A chain tagger for tasks. ``summed``: a token's features add up to ``default``; else its one
    observation replaces it. ``observed`` is what it sees of a row, as hashes."""

    states: list[str]
    start: np.ndarray
    trans: np.ndarray
    default: np.ndarray
    table: SparseRows
    summed: bool
    observed: Column

    def labels(self, obs: pa.Array) -> pa.Array:
        lengths = np.asarray(pa.compute.list_value_length(obs).fill_null(0))
        flat = obs.flatten()
        if not self.summed:
            hashes = flat.to_numpy(zero_copy_only=False)
            return decode(lambda a, b: self.table.replaced(hashes[a:b], self.default), lengths, self.start, self.trans, self.states)
        sizes = np.asarray(pa.compute.list_value_length(flat))
        hashes, ends = flat.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)

        def scores(a: int, b: int) -> np.ndarray:
            lo, hi = (ends[a] - sizes[a], ends[b - 1]) if b > a else (0, 0)
            return self.table.summed(hashes[lo:hi], np.repeat(np.arange(b - a), sizes[a:b]), b - a, self.default)

        return decode(scores, lengths, self.start, self.trans, self.states)


class ModelTooLarge(ValueError):
    """A model that may not travel to tasks."""


def _fits(table: SparseRows | None) -> SparseRows:
    if table is None:
        raise ModelTooLarge("a model is too large to travel to tasks; score it alone with tag_hmm or tag_linear, which join it")
    return table


def hmm_model(model: dict[str, DataFrame], hybrid: bool = False, tokens: str = "tokens", model_bytes: int = MODEL_BYTES) -> ChainModel:
    states, start, trans, unseen = _parameters(model)
    table = _fits(sparse_rows(model["emission"], "token", "logp", states, model_bytes))
    return ChainModel(states, start, trans, unseen, table, False, hashed(observed(tokens, hybrid)))


def linear_model(weights: dict[str, DataFrame], df: DataFrame, model_bytes: int = MODEL_BYTES) -> ChainModel:
    """``df`` has the ``features`` that the model is to see."""
    states, _, trans = _matrices(weights)
    base = state_vector(weights["state"], states)
    table = _fits(sparse_rows(weights["state"].where(F.col("feature") != INTERCEPT), "feature", "weight", states, model_bytes))
    return ChainModel(states, np.zeros(len(states)), trans, base, table, True, F.transform(feature_strings(df), hashed))


def predict_models(df: DataFrame, models: dict[str, ChainModel]) -> DataFrame:
    """``df`` with ``pred_<name>`` of every model; ``features`` goes. No row is shuffled."""
    kept = [c for c in df.columns if c != "features"]
    names = list(models)
    plain = {n: (m.states, m.start, m.trans, m.default, m.table, m.summed) for n, m in models.items()}
    shared = df.sparkSession.sparkContext.broadcast(plain)

    def run(batches):
        own = {n: ChainModel(*parts, None) for n, parts in shared.value.items()}
        for batch in batches:
            found = [own[n].labels(batch.column(f"_obs_{n}")) for n in names]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *found], [*kept, *[f"pred_{n}" for n in names]])

    schema = df.select(*kept).schema
    for n in names:
        schema = schema.add(f"pred_{n}", T.ArrayType(T.StringType()))
    return df.select(*kept, *[m.observed.alias(f"_obs_{n}") for n, m in models.items()]).mapInArrow(run, schema)


def predict_fitted(df: DataFrame, tables: dict[str, dict], hybrid=("hybrid_hmm",), model_bytes: int = MODEL_BYTES) -> DataFrame:
    """``df`` with ``pred_<name>`` of every model given as its tables (with ``emission``: hidden Markov, else
    linear); ``features`` goes. Models of at most ``model_bytes`` share one pass, each larger one is joined."""
    small, large = {}, []
    for name, parts in tables.items():
        try:
            small[name] = hmm_model(parts, name in hybrid, model_bytes=model_bytes) if "emission" in parts else linear_model(parts, df, model_bytes)
        except ModelTooLarge:
            large.append(name)
    left = [n for n in tables if "emission" not in tables[n]]
    for name in [n for n in large if n in left]:
        left.remove(name)
        again = df.withColumn("_again", F.col("features")) if left else df
        df = tag_linear(again, tables[name], f"pred_{name}", model_bytes).withColumnsRenamed({"_again": "features"})
    df = predict_models(df, small) if small else df.drop("features")
    for name in [n for n in large if "emission" in tables[n]]:
        df = tag_hmm(df, tables[name], name in hybrid, pred=f"pred_{name}", model_bytes=model_bytes)
    return df


def long_predictions(df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """One row per sample and model: ``keep``, ``model``, ``pred``."""
    each = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"pred_{n}").alias("pred")) for n in names])
    return df.select(*keep, F.explode(each).alias("m")).select(*keep, "m.model", "m.pred")
