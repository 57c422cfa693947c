"""Known values to BIO labels, by position search in the payload tokens."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import ENTITY_FIELDS
from ..functions.let import let
from ..functions.text import SEP, decoded_payload, join_tokens, tokenize


def _position(haystack: Column, needle: Column) -> Column:
    """Token index of the first place where the needle tokens stand, else NULL.

    Both are SEP-joined, so one substring search finds whole tokens only; the number of SEPs
    before the hit is the token index.
    """
    at = F.position(needle, haystack)
    head = F.left(haystack, at)
    return F.when(at > 0, F.length(head) - F.length(F.replace(head, F.lit(SEP))) - 1)


def _span(joined: Column, lower: Column, value: Column, name: str) -> Column:
    def place(tokens, needle):
        start = F.coalesce(_position(joined, needle), _position(lower, F.lower(needle))).cast("int")
        return F.when(
            (F.size(tokens) > 0) & start.isNotNull(),
            F.struct(
                F.lit(name).alias("type"), start.alias("start"), (start + F.size(tokens) - 1).alias("end")
            ),
        )

    tokens = tokenize(value)
    return let(place, tokens, join_tokens(tokens))


def match_value_span(tokens_joined, value) -> Column:
    """struct<type, start, end> of the first match of a value in SEP-joined tokens: exact case
    first, then any case; end inclusive, NULL without a match."""
    return let(lambda j, low, v: _span(j, low, v, "VALUE"), tokens_joined, F.lower(tokens_joined), value)


def value_spans(tokens, pii: str) -> Column:
    """Spans of the record's values in entity order, less those that meet one kept before."""

    def all_spans(joined, lower, record):
        return F.array(*[_span(joined, lower, record[f], name) for f, name in ENTITY_FIELDS])

    def keep(kept, s):
        meets = F.exists(kept, lambda k: (s["start"] <= k["end"]) & (k["start"] <= s["end"]))
        return F.when(s.isNull() | meets, kept).otherwise(F.array_append(kept, s))

    joined = join_tokens(tokens)
    found = let(all_spans, joined, F.lower(joined), F.col(pii))
    none = F.array().cast("array<struct<type:string,start:int,end:int>>")
    return F.aggregate(F.array_compact(found), none, keep)


def spans_to_labels(spans: Column, n: Column) -> Column:
    """BIO labels of disjoint spans over n tokens, laid end to end."""

    def build(ss, size):
        last = lambda i: F.coalesce(F.get(ss, i - 1)["end"], F.lit(-1))
        runs = F.transform(
            ss,
            lambda s, i: F.concat(
                F.array_repeat(F.lit("O"), s["start"] - last(i) - 1),
                F.array(F.concat(F.lit("B-"), s["type"])),
                F.array_repeat(F.concat(F.lit("I-"), s["type"]), s["end"] - s["start"]),
            ),
        )
        tail = size - 1 - F.coalesce(F.try_element_at(ss, F.lit(-1))["end"], F.lit(-1))
        return F.concat(F.flatten(runs), F.array_repeat(F.lit("O"), tail))

    by_start = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type")))
    )
    return let(build, by_start, n)


def label_values(df: DataFrame, tokens: str = "tokens", pii: str = "pii_data") -> DataFrame:
    """Add ``labels``: one span per entity in the fixed order, skipped if it meets another."""
    spans = F.coalesce(
        F.when(F.col(pii).isNotNull(), value_spans(tokens, pii)),
        F.array().cast("array<struct<type:string,start:int,end:int>>"),
    )
    return df.withColumn("labels", spans_to_labels(spans, F.size(tokens)))


def label_samples(samples: DataFrame) -> DataFrame:
    """Raw samples to tagged samples: decode form data, tokenise, label the known values."""
    tokens = tokenize(decoded_payload("payload", "format"))
    negative = F.col("format") == "negative"
    tagged = samples.withColumn("tokens", tokens).withColumn(
        "pii_data", F.when(~negative, F.col("pii_data"))
    )
    return label_values(tagged)
