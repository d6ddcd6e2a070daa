"""Neighbours among many copies and repeated rows, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import ann


def test_repeated_rows_of_one_vector(spark):
    rows = [(i, [1.0] * 8) for i in range(1, 11) for _ in range(3)] + [(11, [1.0] * 8)] * 12 + [(100 + i, [1.0] * 7 + [-0.1 * i]) for i in range(9)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 10, 5).collect()
    assert [(r.vec_id, round(r.score, 9)) for r in sorted(got, key=lambda r: r["rank"])] == [(i, 1.0) for i in range(1, 6)]


def test_recall_beside_many_copies(spark):
    """Three of five rows are copies of few vectors; the others are clustered around centres."""
    rng = np.random.default_rng(6)
    copies = np.repeat(rng.normal(size=(30, 64)), 100, axis=0)
    others = np.repeat(rng.normal(size=(200, 64)), 10, axis=0) + 0.7 * rng.normal(size=(2000, 64))
    m = np.vstack([copies, others])
    ids = np.arange(len(m))
    df = spark.createDataFrame(list(zip(ids.tolist(), m.tolist(), strict=True)), "vec_id long, embedding array<double>")
    got: dict[int, set] = {}
    for r in ann.nearest(df, (F.col("vec_id") >= 3000) & (F.col("vec_id") % 20 == 0), 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits = 0
    for q in (queries := ids[(ids >= 3000) & (ids % 20 == 0)]):
        s = unit @ unit[q]
        s[q] = -9
        hits += len(got[int(q)] & set(np.argsort(-s)[:5].tolist()))
    assert hits / 5 / len(queries) >= 0.9
