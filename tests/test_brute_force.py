"""Fuzzy ratios and dense search against the plainest way to compute them."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.functions import similarity
from quarry.operators import retrieve


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain_ratio(a, b):
    return 2 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def plain_partial(a, b):
    if not a or not b:
        return 1.0 if a == b else 0.0
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    windows = lambda x, y: [y[max(0, i) : i + len(x)] for i in range(1 - len(x), len(y))]
    best = max(plain_ratio(s, w) for w in windows(s, t))
    return max(best, max(plain_ratio(t, w) for w in windows(t, s))) if len(a) == len(b) else best


@settings(max_examples=300, deadline=None)
@given(st.text("abcd ç", max_size=14), st.text("abcd ç", max_size=25))
def test_ratios(a, b):
    assert similarity.lcs(a, b) == plain_lcs(a, b)
    assert abs(similarity.ratio(a, b) - plain_ratio(a, b)) < 1e-12
    assert abs(similarity.partial_ratio(a, b) - plain_partial(a, b)) < 1e-12
    assert abs(similarity.token_sort_ratio(a, b) - plain_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))) < 1e-12


def test_dense_top_k_with_equal_vectors(spark):
    rng = random.Random(3)
    vectors = [[float(rng.randint(-3, 3)) for _ in range(6)] for _ in range(60)] + [[1.0, 1.0, 0.0, 0.0, 2.0, 0.0]] * 200
    rows = [(i, v) for i, v in enumerate(vectors)]
    rng.shuffle(rows)
    items = spark.createDataFrame([*rows, (999, None)], "item_id long, vec array<double>").repartition(5)
    queries = spark.createDataFrame([(i, v) for i, v in rows if i % 20 == 0] + [(-1, None)], "query_id long, qv array<double>")
    got = {}
    for r in retrieve.dense_top_k(queries, items, 7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.item_id, r.score)
    want = {}
    for i, v in rows:
        if i % 20 == 0:
            best = sorted((-float(np.dot(v, w)), j) for j, w in rows)[:7]
            want[i] = {k + 1: (j, -s) for k, (s, j) in enumerate(best)}
    assert got == want
    small = retrieve.BLOCK
    try:
        retrieve.BLOCK = 4
        again = {(r.query_id, r["rank"]): r.item_id for r in retrieve.dense_top_k(queries, items, 7).collect()}
    finally:
        retrieve.BLOCK = small
    assert again == {(q, k): v[0] for q, ranks in want.items() for k, v in ranks.items()}
