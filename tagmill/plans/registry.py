"""All registered queries."""

from . import comparison_queries, label_queries, model_queries, review_queries, source_queries, text_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (text_queries, label_queries, model_queries, comparison_queries, review_queries, source_queries):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
