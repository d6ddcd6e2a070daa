"""Nearest texts by TF-IDF against all cosines, and the queries that must not join all pairs sharing a term."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import nearest
from quarry.plans import extras, further, text_features  # noqa: F401
from quarry.plans.registry import QUERIES

DIR = "/root/testdata/sf0.001"


def expected(asks, texts, k):
    df = Counter(w for _, x in texts for w in set(x))
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items() if n >= 2}

    def unit(x):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in Counter(x).items() if t in idf}
        size = math.sqrt(sum(v * v for v in w.values()))
        return {t: v / size for t, v in w.items()}

    own, out = [(i, unit(x)) for i, x in texts], {}
    for q, x in asks:
        a = unit(x)
        near = [(-round(sum(v * b[t] for t, v in a.items() if t in b), 6), i) for i, b in own if a.keys() & b.keys()]
        out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(sorted(near)[:k])}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_nearest_against_all_cosines(spark, monkeypatch, small):
    """Copies, ties at the last place, texts without a known term; also with several blocks, cuts and pieces."""
    if small:
        for name, n in (("BLOCK", 7), ("ROWS", 5), ("HITS", 9), ("CELLS", 20)):
            monkeypatch.setattr(nearest, name, n)
    r = random.Random(3)
    texts = [(i, [f"w{r.randrange(12)}" for _ in range(r.randrange(5))]) for i in range(150)] + [(900, ["alone"]), (901, [])]
    asks = [(i, r.choices([f"w{j}" for j in range(14)], k=3)) for i in range(40)] + [(77, ["alone"]), (78, [])]
    got = nearest.nearest(spark.createDataFrame(asks, "q long, x array<string>"), spark.createDataFrame(texts, "i long, x array<string>"), "q", "i", F.col("x"), F.col("x"), 4)
    assert {(x.q, x.rank): (x.i, round(x.score, 6)) for x in got.collect()} == expected(asks, texts, 4)


@pytest.mark.parametrize("name", ["char_tfidf_neighbours", "tfidf_retrieval_topk", "tfidf_mined_negatives", "rerank_top14", "decorated_candidates", "rerank_report"])
def test_no_join_of_all_pairs_that_share_a_term(spark, name):
    """The scores come from blocked products; a sum over a join by term would shuffle a row for each shared term of each pair."""
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "sum((_l" not in plan
