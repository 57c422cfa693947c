"""Registered queries of the training-text operators, over whole tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import benchmark_search, centroid_clustering, fertility, filter_audit, line_dedup, ngram_join, packing, quality_bayes, raking, recurrent_lm, substring_dedup, url_reputation, winnowing
from .oracles import ORACLES  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    marked = url_reputation.label_outcomes(table(spark, sf_dir, "labels"))
    return url_reputation.judge_urls(pages, url_reputation.page_outcomes(pages).unionByName(marked))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnowing.fingerprint_documents(table(spark, sf_dir, "documents"))
    text = winnowing.fingerprint_text
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), text("fingerprint").alias("fingerprint"),
        text("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score_documents(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bayes.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge_documents(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.mixing_weights(table(spark, sf_dir, "documents"), repeat=True)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_benchmark_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = benchmark_search.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_host_reputation": op1_host_reputation,
    "op2_packing": op2_packing,
    "op3_ngram_join": op3_ngram_join,
    "op4_winnowing": op4_winnowing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_recurrent_lm": op6_recurrent_lm,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_bayes": op8_quality_bayes,
    "op9_fertility": op9_fertility,
    "op10_mixing": op10_mixing,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_benchmark_search": op12_benchmark_search,
    "op13_filter_audit": op13_filter_audit,
}
