"""Hidden Markov tagger: fitting is counting, the model is three tables, tagging is Viterbi.

The emission table is sparse: one row per (state, token) seen, and one default per state for
the rest, so it never takes states x vocabulary space.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fixed import UNKNOWN_TOKEN
from ..functions.labels import mask_pattern_token
from ..functions.let import let
from ..functions.text import token_lowers
from .common import barrier_udf, explode_rows, lookup_join, with_row_key
from .sparse import MODEL_BYTES, sparse_rows

# Cells of score vectors, and of state pairs in one step, that are held at once.
CELLS = 250_000


def observed(tokens: str, hybrid: bool):
    """What the model sees: lower-case tokens, with ID and phone patterns folded if hybrid."""
    return F.transform(tokens, mask_pattern_token) if hybrid else token_lowers(tokens)


def hmm_counts(train: DataFrame, hybrid: bool = False, tokens="tokens", labels="labels") -> DataFrame:
    """(kind, prev, state, token, n): start, transition and emission counts in one pass."""
    event = lambda kind, prev, state, token: F.struct(
        F.lit(kind).alias("kind"), prev.alias("prev"), state.alias("state"), token.alias("token")
    )
    none = F.lit(None).cast("string")

    def events(obs, lab):
        steps = F.zip_with(obs, lab, lambda t, l: event("emission", none, l, t))
        moves = F.transform(
            lab,
            lambda l, i: F.when(i == 0, event("start", none, l, none)).otherwise(
                event("trans", F.get(lab, i - 1), l, none)
            ),
        )
        return F.concat(moves, steps)

    return (
        explode_rows(train, [], let(events, observed(tokens, hybrid), labels), "e")
        .groupBy("e.kind", "e.prev", "e.state", "e.token")
        .agg(F.count("*").alias("n"))
    )


def vocabulary(train: DataFrame, hybrid: bool = False, tokens="tokens") -> DataFrame:
    """Distinct observed tokens and the stand-in for unknown ones."""
    seen = explode_rows(train, [], observed(tokens, hybrid), "token")
    return seen.union(train.sparkSession.createDataFrame([(UNKNOWN_TOKEN,)], "token string")).distinct()


def fit_hmm(train: DataFrame, alpha: float = 1.0, hybrid: bool = False, counts: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables start(state, logp), trans(prev, state, logp), emission(state, token, logp) and
    unseen(state, logp), add-alpha smoothed.

    ``counts`` may be given written out, so that the four tables do not each count again.
    States are the few labels seen; only aggregated rows go through the small windows.
    """
    counts = hmm_counts(train, hybrid) if counts is None else counts
    everything = Window.partitionBy(F.lit(1))
    emission = counts.where("kind = 'emission'")
    states = emission.groupBy("state").agg(F.sum("n").alias("total"))
    states = states.withColumns(
        {"k": F.count("*").over(everything), "all_states": F.collect_set("state").over(everything)}
    )
    starts = counts.where("kind = 'start'").select("state", "n")
    start = (
        states.join(starts, "state", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .select(
            "state",
            F.log((F.col("n") + alpha) / (F.sum("n").over(everything) + alpha * F.col("k"))).alias("logp"),
        )
    )
    pairs = states.select(F.col("state").alias("prev"), "k", F.explode("all_states").alias("state"))
    moves = counts.where("kind = 'trans'").select("prev", "state", "n")
    from_prev = Window.partitionBy("prev")
    trans = (
        pairs.join(moves, ["prev", "state"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .select(
            "prev",
            "state",
            F.log((F.col("n") + alpha) / (F.sum("n").over(from_prev) + alpha * F.col("k"))).alias("logp"),
        )
    )
    # One number, taken from the counts by a scalar subquery.
    size = emission.agg(F.count_distinct("token") + 1).scalar()
    totals = states.select("state", "total").withColumn("v", size)
    unseen = totals.select("state", F.log(alpha / (F.col("total") + alpha * F.col("v"))).alias("logp"))
    seen = emission.join(totals, "state").select(
        "state", "token", F.log((F.col("n") + alpha) / (F.col("total") + alpha * F.col("v"))).alias("logp")
    )
    return {"start": start, "trans": trans, "emission": seen, "unseen": unseen}


def _viterbi_batch(scores: list[np.ndarray], start: np.ndarray, trans: np.ndarray) -> list[np.ndarray]:
    """Best state paths of sequences of emission scores, step by step over all of them at once.

    Sequences run from long to short, so at each step the live ones are a prefix of the
    batch. Ties go to the lowest state.
    """
    lengths = np.array([len(s) for s in scores])
    order = np.argsort(-lengths, kind="stable")
    out: list = [np.empty(0, dtype=np.int64)] * len(scores)
    flat = np.concatenate([scores[i] for i in order])
    offset = np.concatenate([[0], np.cumsum(lengths[order])])[:-1]
    sizes = lengths[order]
    live = int((sizes > 0).sum())
    best = np.zeros((live, len(start)))
    back = np.zeros((len(flat), len(start)), dtype=np.min_scalar_type(max(len(start) - 1, 0)))
    best[:] = start + flat[offset[:live]]
    for t in range(1, int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -t, side="left"))
        rows = offset[:m] + t
        step = best[:m, :, None] + trans[None] + flat[rows][:, None, :]
        back[rows] = step.argmax(axis=1)
        best[:m] = step.max(axis=1)
    # backwards over all sequences that reach step t at once
    state = best.argmax(axis=1)
    paths = np.empty(len(flat), dtype=np.int64)
    for t in range(int(sizes[0]) - 1 if live else -1, -1, -1):
        m = int(np.searchsorted(-sizes, -t, side="left"))
        rows = offset[:m] + t
        paths[rows] = state[:m]
        state[:m] = back[rows, state[:m]]
    for r in range(live):
        out[order[r]] = paths[offset[r] : offset[r] + sizes[r]]
    return out


def _chunks(lengths: np.ndarray, states: int):
    """Row ranges whose scores and steps take at most CELLS cells each (or one row)."""
    tokens, rows = max(1, CELLS // max(states, 1)), max(1, CELLS // max(states * states, 1))
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and (total + n > tokens or i - begin >= rows):
            yield begin, i
            begin, total = i, 0
        total += int(n)
    if begin < len(lengths):
        yield begin, len(lengths)


def decode(flat_scores, lengths, start, trans, names) -> pa.Array:
    """Arrow list array of labels; ``flat_scores(a, b)`` gives the emission scores of the batch's
    tokens a to b, which are made for a block of rows at a time."""
    ends = np.cumsum(lengths)
    paths = []
    for a, b in _chunks(lengths, len(names)):
        lo = ends[a] - lengths[a]
        scores = flat_scores(lo, ends[b - 1])
        parts = [scores[ends[i] - lengths[i] - lo : ends[i] - lo] for i in range(a, b)]
        paths += _viterbi_batch(parts, start, trans)
    flat = np.concatenate(paths) if paths else np.empty(0, dtype=np.int64)
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(names, pa.string()).take(pa.array(flat)))


def _parameters(model: dict[str, DataFrame]):
    """States in name order, start vector, transition matrix, unseen vector: label-set sized, from one job."""
    none = F.lit(None).cast("string").alias("prev")
    start, trans, unseen = model["start"], model["trans"], model["unseen"]
    rows = (
        start.select(F.lit("start").alias("kind"), none, "state", "logp")
        .union(trans.select(F.lit("trans"), "prev", "state", "logp"))
        .union(unseen.select(F.lit("unseen"), none, "state", "logp"))
        .collect()
    )
    states = sorted(r["state"] for r in rows if r["kind"] == "start")
    index = {s: i for i, s in enumerate(states)}
    out = {"start": np.zeros(len(states)), "unseen": np.zeros(len(states)), "trans": np.zeros((len(states), len(states)))}
    for r in rows:
        at = (index[r["prev"]], index[r["state"]]) if r["kind"] == "trans" else index[r["state"]]
        out[r["kind"]][at] = r["logp"]
    return states, out["start"], out["trans"], out["unseen"]


def hashed(words) -> Column:
    """Hashes of an array of strings, as model tables have them."""
    return F.transform(words, lambda w: F.xxhash64(w))


def tag_hmm(
    df: DataFrame,
    model: dict[str, DataFrame],
    hybrid: bool = False,
    tokens: str = "tokens",
    pred: str = "pred",
    model_bytes: int = MODEL_BYTES,
) -> DataFrame:
    """Add the most likely label sequence per row; rows need no unique id.

    A model of at most ``model_bytes`` travels to the tasks as sparse rows and no row of ``df`` is
    shuffled. A larger one is joined to the tokens, and each row's emission vectors are collected
    again.
    """
    states, start, trans, unseen = _parameters(model)
    table = sparse_rows(model["emission"], "token", "logp", states, model_bytes)
    if table is None:
        return _tag_by_join(df, model, states, start, trans, unseen, hybrid, tokens, pred)
    shared = df.sparkSession.sparkContext.broadcast((table, unseen, start, trans, states))

    @F.arrow_udf("array<string>")
    def viterbi(obs: pa.Array) -> pa.Array:
        known, default, first, move, names = shared.value
        lengths = np.asarray(pa.compute.list_value_length(obs).fill_null(0))
        flat = obs.flatten().to_numpy(zero_copy_only=False)
        return decode(lambda a, b: known.replaced(flat[a:b], default), lengths, first, move, names)

    return df.withColumn("_obs", hashed(observed(tokens, hybrid))).withColumn(pred, barrier_udf(viterbi)("_obs")).drop("_obs")


def _tag_by_join(df, model, states, start, trans, unseen, hybrid, tokens, pred) -> DataFrame:
    df = with_row_key(df)
    vectors = model["emission"].groupBy("token").agg(
        F.map_from_entries(F.collect_list(F.struct("state", "logp"))).alias("m")
    )
    default = {s: float(u) for s, u in zip(states, unseen)}
    vectors = vectors.select(
        "token",
        F.array(*[F.coalesce(F.try_element_at("m", F.lit(s)), F.lit(default[s])) for s in states]).alias("e"),
    )
    long = explode_rows(df, ["_row"], observed(tokens, hybrid), "token", "pos")
    scored = lookup_join(long, vectors, "token").select(
        "_row", "pos", F.coalesce("e", F.array(*[F.lit(default[s]) for s in states])).alias("e")
    )
    return decode_scored(df, scored, start, trans, states, pred)


def decode_scored(df, scored, start, trans, states, pred) -> DataFrame:
    """Viterbi over per-token score vectors that come as rows (_row, pos, e)."""
    per_row = scored.groupBy("_row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "e"))), lambda x: x["e"]).alias("_e")
    )
    shared = df.sparkSession.sparkContext.broadcast((start, trans, states))

    @F.arrow_udf("array<string>")
    def viterbi(vec: pa.Array) -> pa.Array:
        first, move, names = shared.value
        lengths = np.asarray(pa.compute.list_value_length(vec).fill_null(0))
        flat = vec.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
        return decode(lambda a, b: flat[a:b], lengths, first, move, names)

    return df.join(per_row, "_row", "left").withColumn(
        pred, barrier_udf(viterbi)(F.coalesce("_e", F.array().cast("array<array<double>>")))
    ).drop("_e", "_row")
