"""Agreement of two annotators: span F1, Cohen's kappa, Gwet's AC1, kinds of disagreement."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import ENTITY_TYPES
from ..functions.labels import align_labels, entity_spans, key_bounds, key_type, span_keys
from ..functions.let import let
from ..functions.text import token_gaps, tokenize
from ..functions.verdicts import landis_koch, meets_target, ratio
from .common import barrier_udf, explode_rows
from .metrics import counts_from_keys, entity_counts, scores, with_macro_micro


def _positions(tokens: pa.Array, gaps: pa.Array):
    """Row offsets, start and end character of every token, by one running sum per batch."""
    rows = np.asarray(pa.compute.list_value_length(tokens).fill_null(0))
    tok, gap = np.asarray(tokens.flatten()), np.asarray(gaps.flatten())
    ends_of_rows = np.cumsum(rows)
    starts_of_rows = ends_of_rows - rows
    # Each row has one gap more than tokens; the last gap follows the last token.
    before = np.delete(gap, ends_of_rows + np.arange(len(rows))) if len(rows) else gap
    run = np.cumsum(before + tok)
    base = np.concatenate([[0], run])[starts_of_rows]
    end = run - np.repeat(base, rows)
    return starts_of_rows, ends_of_rows, end - tok, end


def _offsets(tokens: pa.Array, gaps: pa.Array) -> pa.Array:
    first, last, start, end = _positions(tokens, gaps)
    pairs = pa.StructArray.from_arrays(
        [pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["start", "end"]
    )
    return pa.ListArray.from_arrays(pa.array(np.append(first, last[-1:] if len(last) else 0), pa.int32()), pairs)


def _span_labels(tokens: pa.Array, gaps: pa.Array, spans: pa.Array) -> pa.Array:
    """BIO labels of a batch: all spans are laid over all tokens at once.

    Rows are shifted apart, so that one search finds the tokens of every span; where spans overlap, the one
    with the larger start (then the later one) wins, by a running maximum over its tokens.
    """
    first, last, start, end = _positions(tokens, gaps)
    n, rows = len(start), np.asarray(pa.compute.list_value_length(spans).fill_null(0))
    flat = spans.flatten()
    row = np.repeat(np.arange(len(rows)), rows)
    lo, hi = (flat.field(c).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
    named = pa.compute.list_value_length(flat.field("labels")).fill_null(0).to_numpy(zero_copy_only=False) > 0
    known = named & ~np.asarray(flat.field("start").is_null()) & ~np.asarray(flat.field("end").is_null())
    # a span counts from its start on; those of one row stay inside it
    width = int(max(end.max(initial=0), hi.max(initial=0), lo.max(initial=0))) + 2
    owner = np.repeat(np.arange(len(first)), last - first)
    shift = lambda x, r: np.clip(x, 0, width - 1) + r * width
    order = np.lexsort((np.arange(len(row)), lo, row))
    order = order[known[order]]
    a = np.searchsorted(shift(end, owner), shift(lo[order], row[order]), side="right")
    b = np.searchsorted(shift(start, owner), shift(hi[order], row[order]), side="left")
    a, b = np.maximum(a, first[row[order]]), np.minimum(b, last[row[order]])
    full = a < b
    order, a, b = order[full], a[full], b[full]
    size = b - a
    at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    which = np.full(n, -1)
    np.maximum.at(which, at, np.repeat(np.arange(len(order)), size))
    labels = pa.compute.list_element(flat.field("labels").filter(pa.array(named)), 0)
    place = np.cumsum(named) - 1
    covered = np.flatnonzero(which >= 0)
    names = labels.take(pa.array(place[order[which[covered]]])) if len(covered) else pa.array([], pa.string())
    begins = covered == a[which[covered]] if len(covered) else np.zeros(0, bool)
    tag = pa.compute.binary_join_element_wise(pa.array(np.where(begins, "B", "I").astype(object), pa.string()), names.cast(pa.string()), "-")
    out = np.full(n, "O", object)
    out[covered] = tag.to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.append(first, last[-1:] if len(last) else 0), pa.int32()), pa.array(out, pa.string()))


def _lengths(texts) -> Column:
    return F.transform(texts, lambda t: F.length(t))


def tokenize_with_offsets(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``tokens`` and ``offsets`` (character start and end, end exclusive)."""
    return df.withColumn("tokens", tokenize(text)).withColumn(
        "offsets", barrier_udf(F.arrow_udf(_offsets, "array<struct<start:int,end:int>>"))(_lengths("tokens"), _lengths(token_gaps(text)))
    )


def spans_to_bio(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Add ``tokens`` and ``labels`` from character spans; later spans overwrite earlier ones."""
    narrow = F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["labels"].alias("labels"))
    )
    return df.withColumn("tokens", tokenize(text)).withColumn(
        "labels", barrier_udf(F.arrow_udf(_span_labels, "array<string>"))(_lengths("tokens"), _lengths(token_gaps(text)), narrow)
    )


def role_of_annotator(email, uid, a: str, b: str) -> Column:
    """A, B or NULL for an annotator known by mail address or number."""
    email, uid = (F.col(c) if isinstance(c, str) else c for c in (email, uid))
    return F.when((email == a) | (uid == a), "A").when((email == b) | (uid == b), "B")


def first_annotation(rows: DataFrame, task="task_id", role="role", order="position") -> DataFrame:
    """The first row per task and role."""
    others = [c for c in rows.columns if c not in (task, role)]
    best = rows.groupBy(task, role).agg(F.min_by(F.struct(*others), order).alias("r"))
    return best.select(task, role, "r.*")


def pair_annotators(rows: DataFrame, task="task_id", role="role", order="position") -> DataFrame:
    """(task, tokens, labels_a, labels_b) of tasks that both annotators labelled."""
    pick = lambda r, c: F.min_by(F.when(F.col(role) == r, F.col(c)), F.when(F.col(role) == r, F.col(order)))
    return (
        rows.groupBy(task)
        .agg(
            F.min_by("tokens", order).alias("tokens"),
            pick("A", "labels").alias("labels_a"),
            pick("B", "labels").alias("labels_b"),
        )
        .where("labels_a is not null and labels_b is not null")
    )


def annotation_pair_counts(rows: DataFrame, task="task_id", role="role") -> DataFrame:
    """Annotation rows, tasks per annotator, and tasks with both."""
    per_task = rows.groupBy(task).agg(
        F.count("*").alias("n"),
        F.max((F.col(role) == "A").cast("int")).alias("a"),
        F.max((F.col(role) == "B").cast("int")).alias("b"),
    )
    return per_task.agg(
        F.sum("n").alias("annotation_rows"),
        F.sum("a").alias("tasks_a"),
        F.sum("b").alias("tasks_b"),
        F.sum(F.col("a") * F.col("b")).alias("paired_tasks"),
    )


# --- span F1 ---------------------------------------------------------------------------------


def _dense(spans, n) -> Column:
    """For every token the key of the span over it, or NULL: runs laid end to end."""

    def build(ss, keys, size):
        last = lambda i: F.coalesce(F.get(ss, i - 1)["end"], F.lit(-1))
        none = F.lit(None).cast("string")
        runs = F.transform(
            ss,
            lambda s, i: F.concat(
                F.array_repeat(none, s["start"] - last(i) - 1),
                F.array_repeat(F.get(keys, i), s["end"] - s["start"] + 1),
            ),
        )
        tail = size - 1 - F.coalesce(F.try_element_at(ss, F.lit(-1))["end"], F.lit(-1))
        return F.concat(F.flatten(runs), F.array_repeat(none, tail))

    return let(build, spans, span_keys(spans), n)


def _first_meetings(dense_a, dense_b) -> Column:
    """(a, b) keys of each A span and the first B span of its type that shares a token."""
    kind = key_type
    met = F.filter(
        F.zip_with(
            dense_a, dense_b, lambda x, y: F.when(kind(x) == kind(y), F.struct(x.alias("a"), y.alias("b")))
        ),
        lambda p: p.isNotNull(),
    )
    return let(
        lambda ps: F.filter(ps, lambda p, i: (i == 0) | (F.get(ps, i - 1)["a"] != p["a"])), met
    )


def match_spans_relaxed(pairs: DataFrame, a="labels_a", b="labels_b", types=ENTITY_TYPES) -> DataFrame:
    """Add arrays tp, fp, fn of span keys: same type, at least one token shared.

    Each span of A takes its first overlapping span of B. Overlaps are read off token by
    token from two aligned arrays, so a long text costs its length, not the product of its
    span counts.
    """
    df = pairs.withColumns({"_sa": entity_spans(a, types), "_sb": entity_spans(b, types)})
    df = df.withColumn("_first", _first_meetings(_dense("_sa", F.size(a)), _dense("_sb", F.size(b))))
    df = df.withColumn("tp", F.transform("_first", lambda p: p["a"]))
    return df.withColumns(
        {
            "fn": F.array_except(span_keys("_sa"), "tp"),
            "fp": F.array_except(span_keys("_sb"), F.transform("_first", lambda p: p["b"])),
        }
    ).drop("_sa", "_sb", "_first")


def span_f1(pairs: DataFrame, mode: str = "strict", keys: list[str] = (), types=ENTITY_TYPES) -> DataFrame:
    """Pairwise F1 with A as truth, values rounded to 4 places."""
    keys = list(keys)
    if mode == "strict":
        counts = entity_counts(pairs, keys, "labels_a", "labels_b", types)
    else:
        counts = counts_from_keys(match_spans_relaxed(pairs, types=types), keys, "tp", "fp", "fn")
    return with_macro_micro(scores(counts), keys, 4)


def classify_disagreements(pairs: DataFrame, task="task_id", types=ENTITY_TYPES) -> DataFrame:
    """One row per span that only one annotator has: boundary, type, missing, or review.

    Boundary and type cases are reported from A's side; the fourth class of the guide,
    genuine ambiguity, needs a person, so other overlaps are marked ``review``.
    """
    df = pairs.withColumns({"_sa": entity_spans("labels_a", types), "_sb": entity_spans("labels_b", types)})
    df = df.withColumns(
        {
            "_ka": span_keys("_sa"),
            "_kb": span_keys("_sb"),
            "_da": _dense("_sa", F.size("labels_a")),
            "_db": _dense("_sb", F.size("labels_b")),
        }
    )

    def rows(side, own, other, dense):
        return let(lambda d: F.transform(F.array_except(own, other), lambda k: one(side, d, k)), dense)

    def one(side, dense, k):
        start, end = key_bounds(k)
        over = F.filter(F.slice(dense, start + 1, end - start + 1), lambda x: x.isNotNull())
        same_type = F.exists(over, lambda x: key_type(x) == key_type(k))
        same_bounds = F.exists(over, lambda x: (key_bounds(x)[0] == start) & (key_bounds(x)[1] == end))
        return F.struct(
            F.lit(side).alias("side"),
            key_type(k).alias("entity"),
            start.alias("start"),
            end.alias("end"),
            F.when(F.size(over) == 0, "missing")
            .when(same_type, "boundary")
            .when(same_bounds, "type")
            .otherwise("review")
            .alias("kind"),
        )

    found = F.concat(
        rows("A", "_ka", "_kb", "_db"),
        F.filter(rows("B", "_kb", "_ka", "_da"), lambda r: r["kind"] == "missing"),
    )
    return explode_rows(df, [task], found, "d").select(task, "d.*")


# --- chance-corrected agreement --------------------------------------------------------------


def confusion_cells(pairs: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Per key one row with the confusion cells (a, b, n).

    Tokens are counted by label pair first; labels are a closed set, so what is gathered per
    key is at most the square of its size.
    """
    keys = list(keys)
    counts = (
        explode_rows(pairs, keys, align_labels("labels_a", "labels_b"), "p")
        .groupBy(*keys, "p.a", "p.b")
        .agg(F.count("*").alias("n"))
    )
    return counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", "b", "n"))).alias("cells"))


def _total(cells, value) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + value(c))


def _labels(cells) -> Column:
    return F.array_sort(
        F.array_distinct(F.concat(F.transform(cells, lambda c: c["a"]), F.transform(cells, lambda c: c["b"])))
    )


def _kappa_columns(df: DataFrame, cells: str) -> DataFrame:
    """Add n, po, pe of Cohen's kappa."""
    col = F.col(cells)
    side = lambda s, x: _total(F.filter(col, lambda c: c[s] == x), lambda c: c["n"])
    df = df.withColumn("_n", _total(col, lambda c: c["n"]))
    df = df.withColumn("_agree", _total(F.filter(col, lambda c: c["a"] == c["b"]), lambda c: c["n"]))
    df = df.withColumn(
        "_expect", F.aggregate(_labels(col), F.lit(0.0), lambda acc, x: acc + side("a", x) * side("b", x))
    )
    return df.withColumns(
        {"po": ratio("_agree", "_n"), "pe": ratio("_expect", F.col("_n") * F.col("_n"))}
    )


def cohen_kappa(cells: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Kappa and raw agreement over tokens that at least one annotator labelled."""
    df = cells.withColumn("_c", F.filter("cells", lambda c: (c["a"] != "O") | (c["b"] != "O")))
    df = _kappa_columns(df, "_c")
    kappa = F.when(F.col("_n") < 2, 0.0).otherwise(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")))
    return df.select(
        *keys,
        F.round(kappa, 4).alias("kappa"),
        F.round(F.when(F.col("_n") < 2, 0.0).otherwise(F.col("po")), 4).alias("agreement"),
        F.when(F.col("_n") < 2, 0).otherwise(F.col("_n")).cast("long").alias("n_tokens"),
        landis_koch(kappa).alias("interpretation"),
    )


def _binary(cells: DataFrame, keys: list[str], types) -> DataFrame:
    """Per entity the 2x2 counts of in-entity against not, from the same cells."""
    names = F.array(*[F.lit(t) for t in types])
    df = cells.select(*keys, "cells", F.explode(names).alias("entity"))
    suffix = F.concat(F.lit("-"), F.col("entity"))

    def count(in_a, in_b):
        return _total(
            F.filter(
                "cells",
                lambda c: (F.endswith(c["a"], suffix) == F.lit(in_a)) & (F.endswith(c["b"], suffix) == F.lit(in_b)),
            ),
            lambda c: c["n"],
        )

    return df.select(
        *keys, "entity",
        count(True, True).alias("yy"), count(True, False).alias("yn"),
        count(False, True).alias("ny"), count(False, False).alias("nn"),
    )


def cohen_kappa_by_entity(cells: DataFrame, keys: list[str] = (), types=ENTITY_TYPES) -> DataFrame:
    """Binary kappa per entity over all tokens; with one class only, 1 if equal else 0."""
    keys = list(keys)
    df = _binary(cells, keys, types)
    yy, yn, ny, nn = (F.col(c) for c in ("yy", "yn", "ny", "nn"))
    n = yy + yn + ny + nn
    po = ratio(yy + nn, n)
    pe = ratio((yy + yn) * (yy + ny) + (ny + nn) * (yn + nn), n * n)
    one_class = (yy + yn == 0) | (ny + nn == 0) | (yy + ny == 0) | (yn + nn == 0)
    kappa = F.when(one_class, F.when(yn + ny == 0, 1.0).otherwise(0.0)).otherwise(
        F.try_divide(po - pe, 1 - pe)
    )
    return df.select(
        *keys, "entity", F.round(kappa, 4).alias("kappa"), landis_koch(kappa).alias("interpretation")
    )


def gwet_ac1(cells: DataFrame, keys: list[str] = ()) -> DataFrame:
    """AC1 over all tokens, with the interval of Gwet (2008) for two raters.

    The interval uses a normal quantile with a first-order correction for the degrees of
    freedom; it has no published value to compare with.
    """
    keys = list(keys)
    c = F.col
    df = cells.withColumns(
        {"_n": _total("cells", lambda x: x["n"]), "_labels": _labels(c("cells"))}
    ).withColumn("_q", F.size("_labels"))
    share = lambda x: _total(
        F.filter("cells", lambda y: (y["a"] == x) | (y["b"] == x)),
        lambda y: y["n"] * F.when((y["a"] == x) & (y["b"] == x), 2.0).otherwise(1.0),
    ) / (2 * c("_n"))
    df = df.withColumn("_pi", F.map_from_arrays("_labels", F.transform("_labels", share)))
    df = df.withColumns(
        {
            "_pa": ratio(_total(F.filter("cells", lambda x: x["a"] == x["b"]), lambda x: x["n"]), "_n"),
            "_pe": ratio(
                F.aggregate(F.map_values("_pi"), F.lit(0.0), lambda acc, p: acc + p * (1 - p)), c("_q") - 1
            ),
        }
    )
    df = df.withColumn("_ac", F.try_divide(c("_pa") - c("_pe"), 1 - c("_pe")))

    def square(x):
        pi = lambda s: F.element_at("_pi", x[s])
        hit = F.when(x["a"] == x["b"], 1.0).otherwise(0.0)
        chance = ratio((2 - pi("a") - pi("b")) / 2, c("_q") - 1)
        value = (hit - c("_pe")) / (1 - c("_pe")) - 2 * (1 - c("_ac")) * (chance - c("_pe")) / (1 - c("_pe"))
        return x["n"] * F.pow(value - c("_ac"), 2)

    z = 1.959963984540054
    freedom = c("_n") - 1
    df = df.withColumn("_se", F.sqrt(ratio(_total("cells", square), c("_n") * freedom)))
    reach = (z + F.coalesce(F.try_divide(F.lit((z**3 + z) / 4), freedom), F.lit(0.0))) * c("_se")
    small = c("_n") < 2
    return df.select(
        *keys,
        F.round(F.when(small, 0.0).otherwise(c("_ac")), 4).alias("ac1"),
        F.round(F.when(~small, c("_ac") - reach), 4).alias("ci_low"),
        F.round(F.when(~small, F.least(c("_ac") + reach, F.lit(1.0))), 4).alias("ci_high"),
        c("_n").cast("long").alias("n_tokens"),
        landis_koch("_ac").alias("interpretation"),
    )


def gwet_ac1_by_entity(cells: DataFrame, keys: list[str] = (), types=ENTITY_TYPES) -> DataFrame:
    """Binary AC1 per entity; 1 when both annotators use one and the same class only."""
    keys = list(keys)
    df = _binary(cells, keys, types)
    yy, yn, ny, nn = (F.col(c) for c in ("yy", "yn", "ny", "nn"))
    n = yy + yn + ny + nn
    pi = ratio(2 * yy + yn + ny, 2 * n)
    pe = 2 * pi * (1 - pi)
    ac1 = F.when((yn + ny == 0) & ((yy == 0) | (nn == 0)), 1.0).otherwise(
        F.try_divide(ratio(yy + nn, n) - pe, 1 - pe)
    )
    return df.select(*keys, "entity", F.round(ac1, 4).alias("ac1"), landis_koch(ac1).alias("interpretation"))


def iaa_report(pairs: DataFrame, types=ENTITY_TYPES, span_target=0.75, ac1_target=0.80) -> DataFrame:
    """All agreement numbers as (metric, entity, value, verdict) rows.

    ``pairs`` is read by three aggregations (strict, relaxed, confusion); give it written out
    if it is costly to compute.
    """
    strict, relaxed = span_f1(pairs, "strict", types=types), span_f1(pairs, "relaxed", types=types)
    cells = confusion_cells(pairs)
    row = lambda df, name, value, verdict, entity=F.lit("_all"): df.select(
        F.lit(name).alias("metric"),
        entity.alias("entity"),
        value.cast("double").alias("value"),
        verdict.cast("string").alias("verdict"),
    )
    c = F.col
    reached = lambda v, t: F.when(meets_target(v, t), "TERCAPAI").otherwise("TIDAK TERCAPAI")
    strict_rows = row(
        strict, "span_f1_strict", c("f1"), F.when(c("entity") == "_macro", reached("f1", span_target)), c("entity")
    )
    relaxed_rows = row(relaxed, "span_f1_relaxed", c("f1"), F.lit(None), c("entity"))
    pick = lambda df, name: df.where("entity = '_macro'").select("entity", F.col("f1").alias(name))
    gap = pick(relaxed, "r").join(pick(strict, "s"), "entity")
    parts = [
        strict_rows,
        relaxed_rows,
        row(gap, "relaxed_minus_strict", F.round(c("r") - c("s"), 4), F.lit(None), F.lit("_macro")),
        row(cohen_kappa(cells), "cohen_kappa", c("kappa"), c("interpretation")),
        row(cohen_kappa_by_entity(cells, types=types), "cohen_kappa", c("kappa"), c("interpretation"), c("entity")),
        row(gwet_ac1(cells), "gwet_ac1", c("ac1"), reached("ac1", ac1_target)),
        row(gwet_ac1_by_entity(cells, types=types), "gwet_ac1", c("ac1"), c("interpretation"), c("entity")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
