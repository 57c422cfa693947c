"""BIO label arrays: tests, spans, order checks, and the pattern tagger."""

from pyspark.sql import Column, functions as F

from .let import let
from .fixed import (
    ENTITY_TYPES,
    NIK_PLACEHOLDER,
    NIK_TOKEN,
    PHONE_PLACEHOLDER,
    PHONE_TOKEN,
)


def token_is_nik(token) -> Column:
    return F.rlike(token, F.lit(NIK_TOKEN))


def token_is_phone(token) -> Column:
    return F.rlike(token, F.lit(PHONE_TOKEN))


def all_outside(labels) -> Column:
    return F.forall(labels, lambda x: x == "O")


def any_entity(labels) -> Column:
    return F.exists(labels, lambda x: x != "O")


def any_begin_hit(truth, pred) -> Column:
    """Some position where the true label begins an entity and the prediction equals it."""
    return F.exists(
        align_labels(truth, pred), lambda p: p["a"].startswith("B-") & (p["a"] == p["b"])
    )


def entity_tokens(tokens, labels) -> Column:
    """(token, label) pairs whose label is not O."""
    return F.filter(
        F.zip_with(tokens, labels, lambda t, l: F.struct(t.alias("token"), l.alias("label"))),
        lambda p: p["label"] != "O",
    )


def align_labels(truth, pred) -> Column:
    """Label pairs by position, up to the shorter array."""
    return F.filter(
        F.zip_with(truth, pred, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        lambda p: p["a"].isNotNull() & p["b"].isNotNull(),
    )


def _continues(labels, label, i) -> Column:
    """Whether the label before position i is B- or I- of the same type as an I- label."""
    before = F.get(labels, i - 1)
    return F.coalesce(before.isin(label, F.concat(F.lit("B-"), F.substr(label, F.lit(3)))), F.lit(False))


def order_violations(labels) -> Column:
    """Number of I-X labels not preceded by B-X or I-X."""
    return let(
        lambda ls: F.size(F.filter(ls, lambda l, i: l.startswith("I-") & ~_continues(ls, l, i))), labels
    )


def tag_regex(tokens) -> Column:
    """Labels from the two token patterns alone."""
    return F.transform(
        tokens,
        lambda t: F.when(token_is_nik(t), "B-NIK").when(token_is_phone(t), "B-PHONE").otherwise("O"),
    )


def mask_pattern_token(token) -> Column:
    """One stand-in for all IDs, one for all phones, else the token in lower case."""
    return (
        F.when(token_is_nik(token), NIK_PLACEHOLDER)
        .when(token_is_phone(token), PHONE_PLACEHOLDER)
        .otherwise(F.lower(token))
    )


_PRIVATE = 0xE000  # 6400 code points, enough for 3200 types


def _begin(i: int) -> str:
    return chr(_PRIVATE + 2 * i)


def _inside(i: int) -> str:
    return chr(_PRIVATE + 2 * i + 1)


def label_string(labels, types=ENTITY_TYPES) -> Column:
    """One character per label, of the private use area: one that begins a type, the next one
    that goes on; else a dot."""
    out = F.concat(F.lit("<"), F.array_join(labels, "><"), F.lit(">"))
    for i, t in enumerate(types):
        out = F.replace(out, F.lit(f"<B-{t}>"), F.lit(_begin(i)))
        out = F.replace(out, F.lit(f"<I-{t}>"), F.lit(_inside(i)))
    return F.regexp_replace(out, "<[^>]*>", ".")


def entity_spans(labels, types=ENTITY_TYPES, keep_orphans: bool = False) -> Column:
    """array<struct<type, start, end>> of token positions, end inclusive.

    A B-X label opens a span that the I-X labels right after it extend. An I-X label after
    anything else belongs to no span, or opens one with ``keep_orphans``. Runs are found by
    one regular expression over the label string, in the order of their first positions, so
    the work is linear in the text length.
    """
    begins = [f"B-{t}" for t in types]
    insides = [f"I-{t}" for t in types]
    run = "{0}{1}*+|{1}++" if keep_orphans else "{0}{1}*+"
    runs_pattern = "|".join(run.format(_begin(i), _inside(i)) for i in range(len(types)))
    names = F.array(*[F.lit(t) for t in types])

    def find(ls):
        def opens(l, i):
            if not keep_orphans:
                return l.isin(begins)
            return l.isin(begins) | (l.isin(insides) & ~_continues(ls, l, i))

        starts = F.filter(F.transform(ls, lambda l, i: F.when(opens(l, i), i)), lambda i: i.isNotNull())
        runs = F.regexp_extract_all(label_string(ls, types), F.lit(runs_pattern), F.lit(0))
        return F.zip_with(
            starts,
            runs,
            lambda s, r: F.struct(
                F.get(names, F.shiftright(F.ascii(r) - F.lit(_PRIVATE), 1)).alias("type"),
                s.cast("int").alias("start"),
                (s + F.length(r) - 1).cast("int").alias("end"),
            ),
        )

    return let(find, labels)


def span_text(tokens, span) -> Column:
    return F.array_join(F.slice(tokens, span["start"] + 1, span["end"] - span["start"] + 1), " ")


def spans_with_text(tokens, spans) -> Column:
    """Spans with the entity text, tokens joined by one space."""
    return let(
        lambda ts, ss: F.transform(
            ss,
            lambda s: F.struct(
                s["type"].alias("type"),
                span_text(ts, s).alias("text"),
                s["start"].alias("start"),
                s["end"].alias("end"),
            ),
        ),
        tokens,
        spans,
    )


def span_keys(spans) -> Column:
    """Spans as strings, so that array set functions can hash them."""
    return F.transform(
        spans,
        lambda s: F.concat_ws("|", s["type"], s["start"].cast("string"), s["end"].cast("string")),
    )


def key_type(key) -> Column:
    """Type of a span key; it may itself hold the separator."""
    return F.regexp_replace(key, r"\|[0-9]+\|[0-9]+$", "")


def key_bounds(key) -> tuple[Column, Column]:
    """Start and end of a span key."""
    start = F.substring_index(F.substring_index(key, "|", -2), "|", 1)
    return start.cast("int"), F.substring_index(key, "|", -1).cast("int")
