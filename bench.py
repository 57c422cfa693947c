"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; print one JSON line."""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tagmill.functions.labels import tag_regex  # noqa: E402
from tagmill.functions.text import token_gaps, tokenize  # noqa: E402
from tagmill.operators import features, gazetteer, hmm, linear  # noqa: E402
from tagmill.operators.common import materialize  # noqa: E402
from tagmill.operators.masking import mask_text  # noqa: E402
from tagmill.operators.throughput import score_throughput  # noqa: E402
from tagmill.plans import base, comparison_queries, registry  # noqa: E402

HEADLINE = [
    "tokenize_documents", "token_shape_profile", "tag_documents", "nik_validate", "bio_label_main",
    "label_distribution", "stratified_split", "regex_entity_metrics", "metrics_by_format", "build_gazetteer",
    "context_features", "hmm_emission", "hmm_viterbi", "hybrid_hmm_entity_metrics", "robustness_by_category",
    "mcnemar_counts", "test_holdout_gap", "strict_iaa", "relaxed_iaa", "gwet_ac1", "log_detection_metrics",
    "mask_payloads", "stream_detection_counts",
]


def throughput(spark, sf) -> dict:
    """Scoring of every tagger, over payloads and over documents; mean of three runs."""
    docs = materialize(base.texts(spark, sf, "documents").select("doc_id", "text", tokenize("text").alias("tokens")))
    samples = materialize(base.tagged(spark, sf))
    terms = materialize(gazetteer.build_gazetteer(samples))
    tables = {name: {k: materialize(v) for k, v in parts.items()} for name, parts in comparison_queries.fitted(spark, sf).items()}
    words = lambda d: features.token_features(d, use_regex=False, use_gazetteer=False, fields=["word_lower"])
    jobs = {
        "tokenize_documents": (docs, lambda d: d.select(tokenize("text"))),
        "tag_regex_documents": (docs, lambda d: d.select(tag_regex("tokens"))),
        "tag_hmm_payloads": (samples, lambda d: hmm.tag_hmm(d, tables["hmm"])),
        "tag_linear_payloads": (samples, lambda d: linear.tag_linear(words(d), tables["linear"])),
        "mask_regex_documents": (docs, lambda d: d.select(mask_text(token_gaps("text"), tokenize("text"), tag_regex(tokenize("text"))))),
        "tag_hmm_documents": (docs, lambda d: hmm.tag_hmm(d, tables["hmm"])),
        "tag_linear_documents": (docs, lambda d: linear.tag_linear(words(d), tables["linear"])),
        "features_payloads": (samples, lambda d: features.token_features(d, terms)),
    }
    return {name: score_throughput(df, job, F.size("tokens")) for name, (df, job) in jobs.items()}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tagmill-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="bench-"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        queries[name] = round(time.perf_counter() - start, 3)
        print(name, queries[name], file=sys.stderr, flush=True)
    scoring = throughput(spark, sf)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(queries.values()), 3), "unit": "sec",
                "queries": queries, "throughput": scoring, "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
