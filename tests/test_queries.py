"""A sample of the registered queries beside their SQL, on the smallest tables.

All of them, at any scale: ``python -m tests.oracle [--sf DIR]``.
"""

import os

import pytest

import __spark_entry__ as entry
from tests import oracle

SF = "/root/testdata/sf0.001"
NAMES = [
    "tokenize_documents", "word_forms", "nik_validate", "bio_label_main", "bio_label_adversarial", "entity_spans",
    "stratified_split", "regex_entity_metrics", "build_gazetteer", "context_features", "hmm_emission", "relaxed_iaa",
    "gwet_ac1", "log_detection_metrics", "mask_payloads", "stream_detection_counts",
    "match_value_span", "entity_tokens", "mcnemar_stats", "gwet_ac1_interval", "hmm_model_roundtrip", "id_reference",
    "compare_models", "mcnemar_counts", "stream_log_validation", "stream_log_totals", "annotation_export", "loadtest_file", "metrics_roundtrip",
    "log_files", "latency_percentiles", "token_features_trie", "annotation_sheet_file",
    "hmm_viterbi_joined", "token_features_joined", "linear_viterbi", "linear_top_weights", "log_substring_metrics",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    assert oracle.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
