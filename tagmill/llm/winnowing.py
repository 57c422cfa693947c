"""Document fingerprints by winnowing, with DataFrame functions only.

Every run of ``K`` words is hashed; of every ``W`` runs in a row the smallest hash is kept, the
rightmost of equal ones, with its position. Two texts that share ``K + W - 1`` words in a row
therefore share a fingerprint, and the positions say where. Units are words
(``[^\\x20\\x09-\\x0D]+``), unchanged: at 100 TB a hash per character in column expressions costs
six times as much.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagmill.operators.common import materialize

K = 5
# W is 8: three doublings below
W = 8
POSITION_BITS = 24
_MASK = (1 << POSITION_BITS) - 1
_LOWEST = -(1 << 63)
_ROWS_PER_BUCKET = 1000


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the selected values in order of position, array<bigint>. The upper 40 bits
    are the hash; the lower 24 count the position down from 2^24 - 1 (later positions than that
    share the last one). Null and empty texts have none; a text of fewer than K words has one
    hash, of all its words, at position 0. Each step is a projection of its own: columns used
    twice are then not computed twice.
    """
    keep = [F.col(c) for c in df.columns]
    n = F.size("__w")
    df = df.select(*keep, F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "").alias("__w"))
    df = df.select(*keep, n.alias("__n"), F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"))
    n = F.col("__n")

    def pairs(a: str, b: str, shift: int, fn) -> Column:
        return F.zip_with(a, F.slice(b, F.lit(shift + 1), F.greatest(n, F.lit(1))), fn)

    join = lambda x, y: F.xxhash64(x, y)
    df = df.select(*keep, "__n", "__h", pairs("__h", "__h", 1, join).alias("__2"))
    df = df.select(*keep, "__n", "__h", pairs("__2", "__2", 2, join).alias("__4"))
    whole = F.transform(F.slice("__4", 1, 1), lambda x: F.xxhash64(x, n))
    df = df.select(*keep, "__n", F.when(n < K, whole).otherwise(F.slice(pairs("__4", "__h", K - 1, join), F.lit(1), F.greatest(n - (K - 1), F.lit(1)))).alias("__k"))
    packed = F.transform("__k", lambda x, i: x.bitwiseAND(F.lit(~_MASK)).bitwiseOR(F.lit(_MASK) - F.least(i, F.lit(_MASK))))
    df = df.select(*keep, "__n", packed.alias("__m"))
    for shift in (1, 2, 4):
        df = df.select(*keep, "__n", pairs("__m", "__m", shift, lambda x, y: F.least(x, y)).alias("__m"))
    windows = F.greatest(F.lit(1), n - (K + W - 2))
    return df.select(*keep, F.array_distinct(F.slice("__m", F.lit(1), windows)).alias(out))


def fingerprint_text(fingerprint) -> Column:
    """The values in hexadecimal, 16 digits each, joined by spaces."""
    return F.array_join(F.transform(fingerprint, lambda v: F.lower(F.lpad(F.hex(v), 16, "0"))), " ")


def hash_set(fingerprint) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda v: v.bitwiseAND(F.lit(~_MASK))))


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two hash sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(both / F.greatest(every, F.lit(1)))


def _following(values: DataFrame) -> DataFrame:
    """Distinct longs ``v`` and ``next``, the next larger one (the smallest after the largest).
    Works on buckets of values and, for the firsts of the buckets, on itself."""
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n or n <= 10 * _ROWS_PER_BUCKET:
        following = F.lead("v").over(Window.orderBy("v"))  # a bounded number of rows
        return values.select("v", F.coalesce(following, F.lit(low)).alias("next"))
    width = max(1.0, (high - low) / (n / _ROWS_PER_BUCKET))
    bucketed = materialize(values.withColumn("b", F.floor(F.col("v") / width)))
    firsts = bucketed.groupBy("b").agg(F.min("v").alias("v"))
    after = materialize(_following(firsts.select("v")))
    in_bucket = bucketed.withColumn("next", F.lead("v").over(Window.partitionBy("b").orderBy("v")))
    closing = firsts.join(after, "v").select("b", F.col("next").alias("closing"))
    return in_bucket.join(closing, "b").select("v", F.coalesce("next", "closing").alias("next"))


def with_next(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``docs`` with ``next_<c>`` for each carried column: the value in the next document by
    ascending ``doc_id``, after the last one the first.

    Null ids come first; rows of equal id follow one another by ``__tie``. Documents are dealt
    out in buckets of neighbouring ids (a bucket spans so many ids that it holds a thousand
    documents on average) and each bucket also gets a copy of the row that follows it.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    width = max(1.0, ((high or 0) - (low or 0)) / max(1.0, (n or 0) / _ROWS_PER_BUCKET))
    bucket = F.floor(order / F.lit(float(width)))
    firsts = materialize(docs.groupBy(bucket.alias("b")).agg(F.min(order).alias("v")))
    after = materialize(_following(firsts.select("v")))
    closing = materialize(firsts.join(after, "v").select(F.col("b").alias("__b"), F.col("next").alias("__o")))
    rows = docs.withColumns({"__o": order, "__b": bucket, "__s": F.lit(0)})
    extra = docs.withColumn("__o", order).join(closing, "__o").withColumn("__s", F.lit(1))
    w = Window.partitionBy("__b").orderBy("__s", "__o", "__tie")
    both = rows.unionByName(extra.select(*rows.columns))
    led = both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry])
    return led.where("__s = 0").drop("__o", "__b", "__s")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_chars, text, edited`` (the last half of the text
    replaced by the first half of the next document's), the fingerprints of both as arrays,
    ``near_edited`` and ``near_next``.

    Null text counts as empty; repeated rows are documents of their own; other columns are
    ignored; an empty table gives an empty one.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = with_fingerprint(base.withColumn("__tie", F.xxhash64("text")), "text", "fingerprint")
    led = with_next(base, ["text", "fingerprint"])
    half = F.floor(F.char_length("text") / 2).cast("int")
    led = led.withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    led = led.select("doc_id", "n_chars", "text", "fingerprint", "next_fingerprint", edited.alias("edited"))
    led = with_fingerprint(led, "edited", "edited_fingerprint")
    sets = led.select("*", hash_set("fingerprint").alias("__a"), hash_set("edited_fingerprint").alias("__e"), hash_set("next_fingerprint").alias("__x"))
    return sets.select(
        "doc_id", "n_chars", "text", "edited", "fingerprint", "edited_fingerprint",
        likeness("__a", "__e").alias("near_edited"), likeness("__a", "__x").alias("near_next"),
    )
