"""From documents to packed training sequences: quality classifier, line dedup, n-gram Jaccard join,
mixing to target weights, best-fit packing.

Each stage reads what its predecessor kept, written as a table. All but the last return the columns of
``documents``; where a stage changes texts it also sets ``n_chars``. Stages handle nulls, empty
texts, repeated rows and empty tables as their operators say.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagmill.llm import line_dedup, ngram_join, packing, quality_bayes, raking
from tagmill.operators.common import materialize

# Near duplicates: five words a shingle, similarity 0.8 or more.
SHINGLE, NUMERATOR, DENOMINATOR = 5, 80, 100


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality_bayes.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share. Of texts that are mostly such lines the first
    copy keeps them; a document whose every line stands in other documents goes."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    out = line_dedup.drop_common_lines(docs.select(*own), keep_first=True)
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in own:
        kept = F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", kept.cast(docs.schema["n_chars"].dataType))
    return out.select(*own)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    return ngram_join.keep_one(docs, SHINGLE, NUMERATOR, DENOMINATOR)


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled, and repeated where they are too few, so that sources, languages and topics
    are expected to meet their target shares."""
    return raking.mix_documents(docs, repeat=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", without_common_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("mixing_to_targets", mixed_to_targets),
    ("best_fit_packing", packed),
]

# Tokenising and the fitted classifier are beyond SQL; tests hold the stages to planted cases and
# plain versions, run() itself only on an empty table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; tables between stages go to the session's shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
