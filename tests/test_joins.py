"""Joins whose sides are larger than the files they come from."""

import pytest
from pyspark.sql import functions as F

from quarry.plans import further, models, relational, text_features  # noqa: F401
from quarry.plans.adapters import Tables
from quarry.plans.registry import QUERIES

DIR = "/root/testdata/sf0.001"


def test_lists_of_words_are_not_broadcast(spark):
    """Both text sides ask for a merge join, however small their files are."""
    plan = QUERIES["word_overlap_baseline"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 2


def test_training_pairs_travel_with_the_text_of_their_query_only(spark):
    """The lists of words of a query are made above the joins, not shuffled with every pair."""
    plan = models.training(Tables(spark, DIR))._jdf.queryExecution().optimizedPlan().toString()
    first = next(k for k, line in enumerate(plan.split("\n")) if "Join Inner" in line)
    assert any(" AS head#" in line for line in plan.split("\n")[:first])
    assert plan.count("strategy=merge") == 2


def test_lean_pairs_are_those_of_per_pair(spark):
    """Words, stems, heads, content, product and plain words split from lines are those made of the query's text."""
    names = ["q", "sq", "plain", "head", "content", "product"]
    own = Tables(spark, DIR)

    class T:
        pairs, items = own.pairs, own.items
        terms = own.terms.withColumn("query", F.expr("CASE term_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('ve, ', query, '  (x)!') WHEN 2 THEN 've' WHEN 3 THEN concat(query, ' ile için') ELSE query END"))

    one = lambda df: df.select("term_id", "item_id", *[F.to_json(F.struct(F.col(n).alias("x"))).alias(n) for n in names])
    a, b = one(text_features.lean_pairs(T)), one(text_features.per_pair(T))
    assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0


def test_the_ranker_reads_a_written_frame(spark, monkeypatch):
    """The pairs are joined once, not again for the draws, both sides and both reports."""
    class Seen(Exception):
        pass

    def ranker(df, *rest):
        raise Seen(df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(further.ranking, "ranker", ranker)
    with pytest.raises(Seen) as seen:
        QUERIES["pairwise_ranker"](spark, DIR)
    assert "Join" not in str(seen.value)


def test_the_pair_frame_matches_pairs_to_nothing_after_their_item(spark):
    """Ratios and cosine come from the row: the pairs are joined with scores, terms and items only, and carry no lists of their query."""
    from quarry.plans import extras  # noqa: F401

    plan = QUERIES["pair_feature_frame"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    ratios = next(k for k, line in enumerate(lines) if "ArrowEvalPython" in line)
    assert not any("Join" in line for line in lines[:ratios])
    assert plan.count("strategy=merge") == 2
