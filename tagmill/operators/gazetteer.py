"""Mine term lists from labelled training data: a long table (category, term)."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.fixed import (
    JABATAN_PREFIX,
    NEGATIVE_KEYWORDS,
    NIK_LABEL_SEEDS,
    PHONE_LABEL_SEEDS,
    VALUE_DELIMITERS,
)
from ..functions.labels import entity_spans
from ..functions.let import let
from ..functions.text import token_lowers
from .common import explode_rows, materialize, small_rows

CATEGORIES = [
    "jabatan_tokens", "jabatan_phrases", "jabatan_prefix", "lokasi_tokens", "lokasi_phrases",
    "nama_prefixes", "nik_labels", "phone_labels", "negative_keywords",
]


def previous_word(words, i: Column) -> Column:
    """The word before position i, one delimiter skipped; NULL at the start."""
    words = F.col(words) if isinstance(words, str) else words
    one, two = F.get(words, i - 1), F.get(words, i - 2)
    return F.when(one.isin(VALUE_DELIMITERS), F.coalesce(two, one)).otherwise(one)


def _items(tokens: str, labels: str, lowers: str, spans: str) -> Column:
    """array<struct<category, term>> of everything one sample contributes."""
    return let(_collect, tokens, labels, lowers, spans)


def _collect(raw: Column, lab: Column, low: Column, spans: Column) -> Column:
    item = lambda cat, term: F.struct(F.lit(cat).alias("category"), term.alias("term"))

    def inside(entity, cat):
        return F.filter(
            F.zip_with(low, lab, lambda t, l: F.when(l.isin(f"B-{entity}", f"I-{entity}"), item(cat, t))),
            lambda x: x.isNotNull(),
        )

    def phrases(entity, cat):
        long_ones = F.filter(spans, lambda s: (s["type"] == entity) & (s["end"] > s["start"]))
        return F.transform(
            long_ones,
            lambda s: item(cat, F.array_join(F.slice(low, s["start"] + 1, s["end"] - s["start"] + 1), " ")),
        )

    def before(entity, cat):
        found = F.transform(lab, lambda l, i: F.when(l == f"B-{entity}", previous_word(low, i)))
        return F.transform(
            F.filter(found, lambda w: w.isNotNull() & F.rlike(w, F.lit(r"\p{L}"))), lambda w: item(cat, w)
        )

    first_name = F.zip_with(
        raw,
        lab,
        lambda t, l: F.when(
            (l == "B-NAMA") & F.rlike(t, F.lit(r"^\p{Lu}\p{L}+$")), item("nama_prefixes", F.lower(t))
        ),
    )
    return F.concat(
        inside("JABATAN", "jabatan_tokens"),
        phrases("JABATAN", "jabatan_phrases"),
        inside("LOKASI", "lokasi_tokens"),
        phrases("LOKASI", "lokasi_phrases"),
        F.filter(first_name, lambda x: x.isNotNull()),
        before("NIK", "nik_labels"),
        before("PHONE", "phone_labels"),
    )


def mine_counts(train: DataFrame, tokens: str = "tokens", labels: str = "labels", id_col: str = "sample_id") -> DataFrame:
    """(category, term, n, first_seen) in one pass; map-side combine takes up frequent terms."""
    df = train.withColumns({"_low": token_lowers(tokens), "_spans": entity_spans(labels, keep_orphans=True)})
    return (
        explode_rows(df, [id_col], _items(tokens, labels, "_low", "_spans"), "x", "pos")
        .groupBy("x.category", "x.term")
        .agg(F.count("*").alias("n"), F.min(F.struct(id_col, "pos")).alias("first_seen"))
    )


def seed_terms(spark: SparkSession) -> DataFrame:
    rows = [("jabatan_prefix", t) for t in JABATAN_PREFIX]
    rows += [("nik_labels", t) for t in NIK_LABEL_SEEDS]
    rows += [("phone_labels", t) for t in PHONE_LABEL_SEEDS]
    rows += [("negative_keywords", t) for t in NEGATIVE_KEYWORDS]
    return spark.createDataFrame(rows, "category string, term string")


def top_terms(counts: DataFrame, category: str, k: int) -> DataFrame:
    """The k most frequent terms, ties by first appearance."""
    return (
        counts.where(F.col("category") == category)
        .orderBy(F.desc("n"), "first_seen")
        .limit(k)
        .select("category", "term", "n")
    )


def build_gazetteer(train: DataFrame, min_count: int = 2, top_names: int = 500, **columns) -> DataFrame:
    counts = materialize(mine_counts(train, **columns))  # read twice; all samples would be mined for each
    repeated = ["jabatan_tokens", "jabatan_phrases", "lokasi_tokens", "lokasi_phrases"]
    mined = counts.where(
        (F.col("category").isin(repeated) & (F.col("n") >= min_count))
        | F.col("category").isin("nik_labels", "phone_labels")
    ).select("category", "term")
    names = top_terms(counts, "nama_prefixes", top_names).select("category", "term")
    return mined.unionByName(names).unionByName(seed_terms(train.sparkSession)).distinct()


# Terms that may go into a plan as literals; longer lists are joined.
SMALL_TERMS = 20_000


def keywords(gazetteer: DataFrame) -> list[str] | None:
    """The negative keywords of a term table, the built-in ones if it has none, or None if they are
    too many to be tried inside every word."""
    rows = small_rows(gazetteer.where("category = 'negative_keywords'").select("term").distinct(), SMALL_TERMS)
    return None if rows is None else sorted(r["term"] for r in rows) or NEGATIVE_KEYWORDS


def as_sets(gazetteer: DataFrame, limit: int = SMALL_TERMS) -> dict[str, list[str]] | None:
    """The term lists as Python lists if they are few enough to go into a plan, else None."""
    rows = small_rows(gazetteer, limit)
    if rows is None:
        return None
    out: dict[str, list[str]] = {c: [] for c in CATEGORIES}
    for r in rows:
        out.setdefault(r["category"], []).append(r["term"])
    return {c: sorted(v) for c, v in out.items()}
