"""Quality and toxicity classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model over hashed words and the form of the text gives each document's evidence. Labelled
outcomes are counted per path (host and language here) and host, and sparse ones are shrunk
towards their host and all hosts towards the global rate, with strengths estimated from the
counts. Evidence and path rate are added as log odds.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tagmill.operators.common import materialize

from . import words
from .url_reputation import strength

# Bound on the labelled documents that the evidence model is fitted on.
SAMPLE = 20_000
BUCKETS = 1 << 18
# A word is a feature if it is in this many sampled documents and its share among bad ones is off by so many deviations.
MIN_DOCS, MIN_Z, PENALTY = 4, 4.5, 1.0
TARGETS = ("bad", "toxic")
_FORM = 9  # columns of _form
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCTUATION = ~_LETTER & ~_DIGIT & ~words._SPACE


def _share(flags: np.ndarray, b: words.Block) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[b.offsets[1:]] - total[b.offsets[:-1]]


def _form(b: words.Block) -> np.ndarray:
    """What the text looks like: shares of capitals, digits, marks and long words, repetition, length."""
    size = np.maximum(np.diff(b.offsets) - _share(words._SPACE[b.data], b), 1)
    n = np.maximum(b.counts(), 1)
    begin, end = b.first[:-1], b.first[1:]
    lens = b.ends - b.starts
    marked = np.concatenate(([0], np.cumsum(_PUNCTUATION[b.data[b.ends - 1]] if len(lens) else lens)))
    lone = np.concatenate(([0], np.cumsum((lens == 1) & _PUNCTUATION[b.data[b.starts]] if len(lens) else lens)))
    triples = words.grams(b.hashes(), 3)
    repeated = [1 - len(np.unique(t)) / len(t) if len(t := triples[i : max(i, j - 2)]) else 0.0 for i, j in zip(begin, end)]
    columns = [
        np.sqrt(_share(_UPPER[b.data], b) / size), np.sqrt(_share(_DIGIT[b.data], b) / size),
        np.sqrt(_share(_PUNCTUATION[b.data], b) / size), (marked[end] - marked[begin]) / n, (lone[end] - lone[begin]) / n,
        np.array(repeated), size / n / 10, np.minimum(b.counts(), 100) / 100, (b.counts() < 20) * 1.0,
    ]
    return np.stack(columns, 1)


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int32)


def _bare(b: words.Block) -> np.ndarray:
    """Hash bucket of each word without punctuation at its end, so that a word before a full stop is the same."""
    trimmed = words.Block(b.lo, b.hi, np.where(_PUNCTUATION[b.data], np.uint8(32), b.data), b.offsets, b.starts, b.ends, b.first)
    full = ~words._SPACE[trimmed.data]
    begin, end = full.copy(), full.copy()
    begin[1:] &= ~full[:-1]
    end[:-1] &= ~full[1:]
    cut = b.offsets[(b.offsets > 0) & (b.offsets < len(b.data))]
    begin[cut], end[cut - 1] = full[cut], full[cut - 1]
    trimmed.starts, trimmed.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    trimmed.first = np.searchsorted(trimmed.starts, b.offsets)
    return trimmed


def features(rows: DataFrame, carry: list[str]) -> DataFrame:
    """``carry``, ``form`` and ``buckets`` (distinct word buckets) of each (``text``, carry) row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.blocks(batch.column(0), lower=False):
                form = _form(b)
                lower = words.Block(b.lo, b.hi, words._LOWER[b.data], b.offsets, b.starts, b.ends, b.first)
                bare = _bare(lower)
                at = _buckets(bare.hashes())
                own = [np.unique(at[i:j]) for i, j in zip(bare.first[:-1], bare.first[1:])]
                cols = [batch.column(i + 1).slice(b.lo, b.hi - b.lo) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(np.arange(len(form) + 1) * _FORM, pa.int32()), pa.array(form.reshape(-1))), pa.array(own, pa.list_(pa.int32()))], [*carry, "form", "buckets"])

    kinds = dict(rows.dtypes)
    return rows.select("text", *carry).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in carry) + ", form array<double>, buckets array<int>")


def telling_words(taken: DataFrame, totals: dict[str, int], n: int) -> dict[str, np.ndarray]:
    """For each target the sorted word buckets that stand out among its documents, counted by Spark."""
    seen = taken.select(F.explode("buckets").alias("b"), *TARGETS).groupBy("b").agg(F.count("*").alias("df"), *[F.sum(t).alias(t) for t in TARGETS])
    off = {}
    for t in TARGETS:
        rate = (totals[t] + 0.5) / (n + 1)
        off[t] = F.abs(F.col(t) - F.col("df") * rate) > MIN_Z * F.sqrt(F.col("df") * rate * (1 - rate))
    rows = seen.where(F.col("df") >= MIN_DOCS).select("b", *[c.alias(t) for t, c in off.items()]).where(" or ".join(TARGETS)).toArrow()
    return {t: np.sort(rows["b"].to_numpy()[rows[t].to_numpy(zero_copy_only=False).astype(bool)]) for t in TARGETS}  # BUCKETS at most


def _chosen_only(taken: DataFrame, chosen: np.ndarray) -> DataFrame:
    """``taken`` with the places in ``chosen`` of its buckets in place of the buckets."""
    shared = taken.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            flat, size = lists.flatten().to_numpy(), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), size)
            place = np.minimum(np.searchsorted(shared.value, flat), max(len(shared.value) - 1, 0))
            hit = shared.value[place] == flat if len(shared.value) else np.zeros(len(flat), bool)
            ends = np.cumsum(np.bincount(owner[hit], minlength=batch.num_rows))
            at = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(place[hit], pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(t) for t in TARGETS], batch.column("form"), at], [*TARGETS, "form", "at"])

    kinds = dict(taken.dtypes)
    return taken.select(*TARGETS, "form", "buckets").mapInArrow(run, ", ".join(f"{t} {kinds[t]}" for t in TARGETS) + ", form array<double>, at array<int>")


def fit(sample: pa.Table, target: str, chosen: np.ndarray) -> dict:
    """A penalised logistic model: form columns and the ``chosen`` word buckets. ``sample`` has a
    row per document with ``form`` and its places ``at`` in ``chosen``; the words are kept as pairs, so memory
    follows the sample, whatever the number of weights."""
    y = sample[target].to_numpy().astype(float)
    n, words_n = len(y), len(chosen)
    lists = sample["at"].combine_chunks()
    at = lists.flatten().to_numpy()
    owner = np.repeat(np.arange(n), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
    dense = np.concatenate((np.ones((n, 1)), sample["form"].combine_chunks().flatten().to_numpy().reshape(n, _FORM)), 1)
    m = dense.shape[1]
    times = lambda w: dense @ w[:m] + np.bincount(owner, w[m:][at], n)
    back = lambda r: np.concatenate((dense.T @ r, np.bincount(at, r[owner], words_n)))
    rate = (y.sum() + 0.5) / (n + 1)
    w = np.zeros(m + words_n)
    w[0] = np.log(rate / (1 - rate))
    penalty = np.full(len(w), PENALTY)
    penalty[0] = 1e-3
    for _ in range(15):  # Newton steps, solved by conjugate gradients
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        g, s = penalty * w + back(p - y), p * (1 - p)
        scale = 1 / (penalty + np.concatenate((dense.T**2 @ s, np.bincount(at, s[owner], words_n))))
        step, rest = np.zeros_like(w), g.copy()
        z = scale * rest
        d, size = z.copy(), rest @ z
        for _ in range(500):
            if size <= 1e-10 * (g @ (scale * g)) or size == 0:
                break
            h = penalty * d + back(s * times(d))
            a = size / (d @ h)
            step, rest = step + a * d, rest - a * h
            z = scale * rest
            d, size = z + (rest @ z) / size * d, rest @ z
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    table = np.zeros(BUCKETS, np.float32)
    table[chosen] = w[m:]
    return {"base": float(np.log(rate / (1 - rate))), "bias": float(w[0]), "form": w[1:m], "table": table}


def evidence(rows: DataFrame, models: dict[str, dict], text: str, carry: list[str]) -> DataFrame:
    """``carry`` and the evidence for each target (``__bad``, ``__toxic``): the model's log odds
    less those of its sample."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(models)  # BUCKETS values per target

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.blocks(batch.column(0)):
                form = _form(b)
                lower = words.Block(b.lo, b.hi, words._LOWER[b.data], b.offsets, b.starts, b.ends, b.first)
                bare = _bare(lower)
                at = _buckets(bare.hashes())
                owner = np.repeat(np.arange(b.hi - b.lo), bare.counts())
                scores = []
                for t in TARGETS:
                    m = shared.value[t]
                    hit = np.flatnonzero(m["table"][at])
                    pair = np.unique(owner[hit].astype(np.int64) << 20 | at[hit])
                    s = np.bincount(pair >> 20, m["table"][pair & (BUCKETS - 1)], b.hi - b.lo)
                    scores.append(pa.array(s + form @ m["form"] + m["bias"] - m["base"], pa.float64()))
                cols = [batch.column(i + 1).slice(b.lo, b.hi - b.lo) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*cols, *scores], [*carry, *[f"__{t}" for t in TARGETS]])

    kinds = dict(rows.dtypes)
    columns = [F.col(f"`{c}`") for c in (text, *carry)]
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carry] + [f"__{t} double" for t in TARGETS])
    return rows.select(*columns).mapInArrow(run, schema)


def path_rates(outcomes: DataFrame, target: str) -> DataFrame:
    """``host, path, <target>_host, <target>_path``: posterior means of the outcome's rate, from
    one row per (host, path) with ``n`` labelled documents and ``<target>`` positive ones."""
    paths = outcomes.select("host", "path", "n", F.col(target).alias("bad"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    one = F.lit(True)
    hosts = hosts.join(F.broadcast(strength(hosts, "mh")), one)  # strength() is a single row
    hosts = hosts.select("host", ((F.col("bad") + F.col("mh") * F.col("mh_mean")) / (F.col("n") + F.col("mh"))).alias(f"{target}_host"))
    paths = paths.join(F.broadcast(strength(paths, "mp")), one).join(hosts, "host")
    rate = (F.col("bad") + F.col("mp") * F.col(f"{target}_host")) / (F.col("n") + F.col("mp"))
    return paths.select("host", "path", f"{target}_host", rate.alias(f"{target}_path"))


def log_odds(p) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))
    return F.log(p / (1 - p))


def labelled(labels: DataFrame) -> DataFrame:
    """One row per labelled document: ``__id``, ``bad`` (any label says quality 0) and ``toxic``."""
    bad, toxic = F.max((F.col("quality") == 0).cast("int")), F.max((F.col("toxic") == 1).cast("int"))
    rows = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    return rows.groupBy(F.col("doc_id").alias("__id")).agg(F.coalesce(bad, F.lit(0)).alias("bad"), F.coalesce(toxic, F.lit(0)).alias("toxic"))


def _judged(docs: DataFrame, labels: DataFrame, threshold: float, sample: int) -> DataFrame:
    """``docs`` with ``__host, __path``, the evidence, rates and posteriors, and ``__kept``. The
    texts are scored where they are; only labels and small tables are shuffled."""
    text, host = F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))
    path = F.concat(host, F.lit("/"), F.coalesce("lang", F.lit("")))
    rows = docs.select("doc_id", text.alias("text"), host.alias("host"), path.alias("path"))
    known = labelled(labels)
    ids = rows.select("doc_id", "host", "path").dropDuplicates(["doc_id"]).join(known, F.col("doc_id") == F.col("__id"))
    ids = materialize(ids.select("__id", "host", "path", *TARGETS))
    # a bounded sample, chosen by a hash of the id: about ``sample`` documents of all tasks
    share = min(1.0, sample / max(ids.count(), 1))
    chosen = ids.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("__id", *TARGETS)
    drawn = rows.select("doc_id", "text").join(F.broadcast(materialize(chosen)), F.col("doc_id") == F.col("__id"))
    taken = materialize(features(drawn.select("text", *TARGETS), list(TARGETS)))
    n, *sums = taken.agg(F.count("*"), *[F.coalesce(F.sum(t), F.lit(0)) for t in TARGETS]).first()
    telling = telling_words(taken, dict(zip(TARGETS, sums)), n)
    models = {t: fit(_chosen_only(taken, telling[t]).toArrow(), t, telling[t]) for t in TARGETS}
    outcomes = materialize(ids.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]))
    every = materialize(rows.select("host", "path").distinct().join(outcomes, ["host", "path"], "left").fillna(0))
    rates = path_rates(every, "bad").join(path_rates(every, "toxic"), ["host", "path"])
    rates = rates.select(*[F.col(c).alias(f"__{c}") for c in rates.columns])
    whole = docs.withColumns({"__text": text, "__host": host, "__path": path})
    scored = evidence(whole, models, "__text", [*docs.columns, "__host", "__path"])
    joined = scored.join(materialize(rates), ["__host", "__path"], "left")
    joined = joined.withColumns({f"__{t}_p": 1 / (1 + F.exp(-(F.col(f"__{t}") + log_odds(f"__{t}_path")))) for t in TARGETS})
    return joined.withColumn("__kept", (F.col("__bad_p") < threshold) & (F.col("__toxic_p") < threshold))


def judge_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.6, sample: int = SAMPLE) -> DataFrame:
    """One row per document: ``doc_id, host, path``, for ``bad`` and ``toxic`` the evidence, the
    host's and the path's rate and the posterior ``p``, and ``kept`` (both posteriors below
    ``threshold``).

    Null texts count as empty; a null source or language is a value of its own; labels of
    unknown documents do not count, and without any label every document is kept. Repeated rows
    are judged alike; an empty table gives an empty one; other columns are ignored.
    """
    out = _judged(docs.select("doc_id", "text", "source", "lang"), labels, threshold, sample)
    parts = [(f"__{t}{s}", f"{t}{n}") for t in TARGETS for s, n in (("", "_evidence"), ("_host", "_host"), ("_path", "_path"), ("_p", "_p"))]
    return out.select("doc_id", F.col("__host").alias("host"), F.col("__path").alias("path"), *[F.col(a).alias(b) for a, b in parts], F.col("__kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.6, sample: int = SAMPLE) -> DataFrame:
    """The documents that are kept, with all columns of ``docs`` (none may start with two
    underscores)."""
    return _judged(docs, labels, threshold, sample).where("__kept").select(*[F.col(f"`{c}`") for c in docs.columns])
