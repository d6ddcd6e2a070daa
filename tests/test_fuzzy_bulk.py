"""Ratios of many pairs at once are those of one pair at a time."""

import random

import pandas as pd
import pytest

from quarry.functions import similarity as s


@pytest.mark.parametrize("bulk", [3, 2048])
def test_ratios_of_many_pairs(monkeypatch, bulk):
    monkeypatch.setattr(s, "BULK", bulk)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abçdı1") for _ in range(r.randint(1, 6)))
    text = lambda: " ".join(word() for _ in range(r.randint(0, 7)))
    pairs = [(text(), text()) for _ in range(300)] + [("", ""), ("a", ""), ("ab" * 32, "ba" * 32), ("a" * 64, "b" + "a" * 70), ("ab " * 40, "ba " * 45), ("x", "ab " * 100), ("😀 ab", "ab 😀c"), (None, "a"), ("abc", "xyz")]
    pairs += [(f"{a} {b}", b) for a, b in pairs[:40]] + pairs[:9]
    got = s._ratios(*(pd.Series(list(x)) for x in zip(*pairs)))
    for (a, b), row in zip(pairs, got.to_dict("records")):
        a, b = a or "", b or ""
        assert row == {"fuzz_basic": s.ratio(a, b), "fuzz_partial": s.partial_ratio(a, b), "fuzz_sort": s.token_sort_ratio(a, b), "fuzz_set": s.token_set_ratio(a, b)}


def test_cosine_from_the_terms_and_a_norm(spark):
    """As by joining the weights of both texts; repeated words, texts without weights and null too."""
    from pyspark.sql import functions as F

    from quarry.functions import text
    from quarry.operators import weights

    texts = ["red shoe red", "red red shoe", "blue shoe", "", None, "lone", "red blue", "red shoe red"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    terms = lambda x: F.concat(weights.words(F.col(x)), text.bigrams(weights.words(F.col(x))))
    w = weights.tfidf(df, df, "k", terms("t"))
    want = {(r.a, r.b): r.score for r in weights.cosine(w.withColumnRenamed("k", "a"), w.withColumnRenamed("k", "b"), "a", "b").collect()}
    v = weights.vectors(df.groupBy("t").agg(F.count("*").alias("times")), "t", terms("t"), times="times")
    own = df.join(v, "t", "left")
    both = own.select(F.col("k").alias("a"), F.col("t").alias("x"), "norm").crossJoin(own.select(F.col("k").alias("b"), "parts"))
    got = both.select("a", "b", weights.dot(terms("x"), F.col("norm"), F.col("parts")).alias("s")).collect()
    assert len(got) == 64 and all(abs(r.s - want.get((r.a, r.b), 0.0)) < 1e-12 for r in got) and want
