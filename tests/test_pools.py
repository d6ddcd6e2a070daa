"""Negatives that are worked out in the workers are those that the joins give, and their pairs are shuffled by term only."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import negatives, pools
from quarry.plans.adapters import Tables
from quarry.plans.models import decorated

DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("make", "each"), [(negatives.rule_sources, 5), (negatives.swap_sources, 2)])
def test_same_negatives_as_by_joins(spark, monkeypatch, make, each):
    p, i = decorated(Tables(spark, DIR))
    p = p.filter("term_id % 9 = 0").withColumn("brand", F.when(F.col("item_id") % 13 != 0, F.col("brand")))  # null keys too
    p, i = p.cache(), i.withColumn("brand", F.when(F.col("item_id") % 13 != 0, F.col("brand"))).cache()
    here = rows(negatives.negatives(p, i, make(), each, 7))
    assert len(here) > 300
    monkeypatch.setattr(pools, "ROWS", 50)  # many cuts between terms
    monkeypatch.setattr(pools, "POSITIVES", 30)  # some terms by joins
    assert 0 < pools.many(p).count() < p.select("term_id").distinct().count()
    assert rows(negatives.negatives(p, i, make(), each, 7)) == here
    monkeypatch.setattr(pools, "ITEMS", 0)
    assert rows(negatives.negatives(p, i, make(), each, 7)) == here


def test_draws_are_not_shuffled(spark):
    """One exchange of the pairs by term above the joins; no join of draws with pools."""
    p, i = decorated(Tables(spark, DIR))
    p = p.select("term_id", "item_id", "main", "sub", "brand", "gender", "age_group", "q_man", "q_woman", "q_child", "q_colour").localCheckpoint()
    plan = negatives.negatives(p, i, negatives.rule_sources())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_empty_and_single(spark):
    p, i = decorated(Tables(spark, DIR))
    assert negatives.negatives(p.limit(0), i, negatives.rule_sources()).count() == 0
    assert negatives.negatives(p.limit(5), i.limit(0), negatives.rule_sources()).count() == 0
