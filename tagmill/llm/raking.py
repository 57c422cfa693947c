"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell (source, language, topic). Raking multiplies the cells by one factor
per value of each dimension until their sums meet the target marginals; a document is then kept
with a probability proportional to its cell's factor, decided by a hash of its id.
"""

import functools

from pyspark.sql import Column, DataFrame, functions as F

from tagmill.operators.common import checked_join, materialize

DIMS = ("source", "lang", "topic")
ROUNDS, TEMPER, SHARE, FLOOR, SEED = 6, 0.7, 0.8, 0.0, "mix"
MOST_ROUNDS, TOLERANCE = 60, 1e-4
_WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text) -> Column:
    """A coarse topic from the form of the text; null or without words: ``empty``."""
    t = F.coalesce(F.col(text), F.lit(""))
    symbols = F.length(t) - F.length(F.translate(t, "#*$%&|<>{}[]=", ""))
    digits = F.length(t) - F.length(F.translate(t, "0123456789", ""))
    words = F.col("__tokens") - 1
    return (
        F.when(words < 1, "empty")
        .when(symbols * 20 > F.length(t), "markup")
        .when(digits * 20 > F.length(t), "figures")
        .when(words < 100, "note")
        .when(words < 1000, "article")
        .otherwise("book")
    )


def token_count(text) -> Column:
    """Words and one end mark."""
    return (F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(_WORD)) + 1).cast("long")


def target_marginals(cells: DataFrame, dim: str, temper: float = TEMPER) -> DataFrame:
    """Target share of each value of ``dim``: its share of tokens to the power ``temper``, so
    that large values lose and small ones gain."""
    t = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t"))
    t = t.withColumn("p", F.pow("t", F.lit(float(temper))))
    return t.join(F.broadcast(t.agg(F.sum("p").alias("all"))), F.lit(True)).select(dim, (F.col("p") / F.col("all")).alias("target"))


def largest_miss(fitted: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The largest difference between a value's raked share and its target."""
    each = [fitted.groupBy(d).agg(F.sum("share").alias("s")).join(t.hint("merge"), d).select(F.abs(F.col("s") - F.col("target")).alias("miss")) for d, t in targets.items()]
    return functools.reduce(DataFrame.unionByName, each).agg(F.max("miss")).first()[0] or 0.0


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float | None = None) -> DataFrame:
    """``cells`` (one row per combination, ``tokens``) with ``share``: the raked share.

    ``targets`` has for each dimension a table of its values and their ``target`` share; a value
    without a target gets none, and a target without cells cannot be met. Each step is a grouped
    sum and a join, written out, so no dimension is gathered in one place. With a ``tolerance``
    it ends before ``rounds`` when no share misses its target by more. Targets are merged, not broadcast:
    broadcasts of many small steps would stay in the driver's heap until it is collected.
    """
    fitted = materialize(cells.withColumn("share", F.col("tokens").cast("double")))
    targets = {dim: materialize(t) for dim, t in targets.items()}
    for _ in range(rounds):
        for dim, target in targets.items():
            sums = fitted.groupBy(dim).agg(F.sum("share").alias("__sum"))
            factor = sums.join(target.hint("merge"), dim, "left").select(dim, F.coalesce(F.try_divide("target", "__sum"), F.lit(0.0)).alias("__f"))
            fitted = materialize(fitted.join(factor, dim, "left").withColumn("share", F.col("share") * F.col("__f")).drop("__f"))
        if tolerance is not None and largest_miss(fitted, targets) <= tolerance:
            break
    return fitted


def uniform(id_col, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id, the same in every engine with md5."""
    head = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)


def calibrated_scale(cells: DataFrame, share: float) -> float:
    """The scale s for which probabilities min(1, s * factor) keep ``share`` of all tokens in
    expectation: two passes over the cells, each with a grid of scales."""
    grid = [2.0 ** (i / 2) for i in range(-40, 41)]
    for _ in range(2):
        sums = [F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(s) * F.col("factor"))).alias(f"s{i}") for i, s in enumerate(grid)]
        row = cells.agg(F.sum("tokens").alias("all"), *sums).first()
        if not row["all"]:
            return 1.0
        at = next((i for i in range(len(grid)) if row[f"s{i}"] >= share * row["all"]), len(grid) - 1)
        low, high = grid[max(at - 1, 0)], grid[at]
        grid = [low + (high - low) * i / 64 for i in range(65)]
    return high


def _weighted(docs: DataFrame, temper: float, rounds: int, share: float, floor: float, targets: dict | None, seed: str, repeat: bool = False, tolerance: float | None = None) -> DataFrame:
    """``docs`` with ``__topic, __tokens, __factor, __p, __kept, __copies``; with ``repeat`` ``__p`` may be above 1."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    cell = ["__source", "__lang", "__topic"]
    keyed = docs.select(
        *own, token_count("text").alias("__tokens"), F.coalesce("source", F.lit("")).alias("__source"), F.coalesce("lang", F.lit("")).alias("__lang")
    ).withColumn("__topic", topic_of("text"))
    cells = materialize(keyed.groupBy(*[F.col(f"__{d}").alias(d) for d in DIMS]).agg(F.sum("__tokens").alias("tokens")))
    marginals = {d: (targets or {}).get(d) for d in DIMS}
    fitted = rake(cells, {d: target_marginals(cells, d, temper) if t is None else t for d, t in marginals.items()}, rounds, tolerance)
    total = fitted.agg(F.sum("tokens").cast("double").alias("all"), F.sum("share").alias("fit"))
    factor = F.coalesce(F.try_divide(F.col("share") * F.col("all"), F.col("tokens") * F.col("fit")), F.lit(0.0))
    factors = materialize(fitted.join(F.broadcast(total), F.lit(True)).select(*DIMS, "tokens", F.round(factor, 6).alias("factor")))
    p = F.col("factor") * F.lit(float(share)) if repeat else F.least(F.lit(1.0), F.greatest(F.lit(float(floor)), F.round(F.col("factor") * calibrated_scale(factors, share), 6)))
    factors = factors.select(*[F.col(d).alias(f"__{d}") for d in DIMS], F.col("factor").alias("__factor"), p.alias("__p"))
    drawn = checked_join(keyed, factors, cell).withColumn("__kept", uniform("doc_id", seed) < F.col("__p"))
    whole = F.floor("__p")
    return drawn.withColumn("__copies", (whole + (uniform("doc_id", seed) < F.col("__p") - whole).cast("long")).cast("int"))


def mixing_weights(docs: DataFrame, temper: float = TEMPER, rounds: int = ROUNDS, share: float = SHARE, floor: float = FLOOR, targets: dict[str, DataFrame] | None = None, seed: str = SEED, repeat: bool = False) -> DataFrame:
    """One row per document: ``doc_id, source, lang, topic, tokens, factor`` (raked share over
    share of tokens), ``probability``, ``kept`` and ``copies``.

    Probabilities are proportional to the factor, at most 1 and at least ``floor``, scaled so
    that ``share`` of all tokens is expected to stay; values whose cells are capped at 1 miss their targets.
    With ``repeat`` they are the expected number of copies, ``share * factor``, so that all values are expected to
    meet their targets as nearly as ``rounds`` rounds of raking do; ``floor`` does not count. Null source or language is a value of its
    own, an empty string; null or empty texts have one token and the topic ``empty``. Repeated
    rows share one decision; an empty table gives an empty one; other columns are ignored.
    """
    out = _weighted(docs.select("doc_id", "text", "source", "lang"), temper, rounds, share, floor, targets, seed, repeat)
    return out.select("doc_id", "source", "lang", *[F.col(f"__{a}").alias(b) for a, b in (("topic", "topic"), ("tokens", "tokens"), ("factor", "factor"), ("p", "probability"), ("kept", "kept"), ("copies", "copies"))])


def mix_documents(docs: DataFrame, temper: float = TEMPER, rounds: int = ROUNDS, share: float = SHARE, floor: float = FLOOR, targets: dict[str, DataFrame] | None = None, seed: str = SEED, repeat: bool = False) -> DataFrame:
    """The sampled documents, with all columns of ``docs`` (none may start with two underscores).

    With ``repeat`` a document is expected ``share * factor`` times, more than once where that is above
    1, so that no cell is capped and the shares of all values are expected to meet their targets;
    raking goes on to ``TOLERANCE``, and ``rounds`` and ``floor`` do not count.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    limits = (MOST_ROUNDS, TOLERANCE) if repeat else (rounds, None)
    mixed = _weighted(docs, temper, limits[0], share, floor, targets, seed, repeat, limits[1])
    if not repeat:
        return mixed.where("__kept").select(*own)
    copies = F.explode(F.array_repeat(F.lit(True), F.col("__copies"))).alias("__copy")  # no rows for 0 times
    return mixed.where("__copies > 0").select(*own, copies).drop("__copy")
