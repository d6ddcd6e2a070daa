"""Searches ask with every query, not with a part of them."""

import pytest

from quarry.plans import extras, further, text_features  # noqa: F401
from quarry.plans.adapters import Tables
from quarry.plans.registry import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["tfidf_retrieval_topk", "rerank_top14", "decorated_candidates", "tfidf_mined_negatives", "char_tfidf_neighbours"])
def test_every_query_asks(spark, name):
    asks = {r.term_id for r in Tables(spark, DIR).terms.select("term_id").collect()}
    assert len(asks) > 100 and {r.term_id for r in QUERIES[name](spark, DIR).select("term_id").distinct().collect()} == asks
