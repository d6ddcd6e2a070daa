"""Array sources, reports, numbering, discounted gain, learning to rank, negatives' pools."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import negatives, ranking, relational
from quarry.sources import io


def test_npy_rows_and_alignment(spark, tmp_path):
    a, b = np.random.default_rng(0).normal(size=(2500, 5)).astype(np.float32), np.arange(12.0).reshape(4, 3)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", b)
    rows = sorted((r.row, r.vec) for r in io.read_npy(spark, str(tmp_path / "a.npy")).collect())
    assert [r[0] for r in rows] == list(range(2500)) and np.array_equal(np.array([r[1] for r in rows], np.float32), a)
    both = io.read_npy(spark, [str(tmp_path / "a.npy"), str(tmp_path / "b.npy")])
    assert {r.n for r in both.groupBy("file").agg(F.count("*").alias("n")).collect()} == {2500, 4}
    ids = spark.createDataFrame([(i, f"id{i}") for i in range(3)], "row long, item string")
    got = {r.item: r.vec for r in io.aligned(io.read_npy(spark, str(tmp_path / "b.npy")), ids, "item").collect()}
    assert got == {f"id{i}": b[i].tolist() for i in range(3)}
    np.save(tmp_path / "c.npy", np.arange(3))
    with pytest.raises(Exception, match="not a two-dimensional"):
        io.read_npy(spark, str(tmp_path / "c.npy")).count()


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, None), ("a", 1, 0.5)], "name string, n int, x double")
    lines = io.report_lines("names", df, ["name"])
    assert [(r.n, r.line) for r in lines.orderBy("n").collect()] == [(0, "== names =="), (1, "name=a  n=1  x=0.5"), (2, "name=b  n=2  x=-")]
    io.write_text(lines, str(tmp_path / "report"))
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ["== names ==", "name=a  n=1  x=0.5", "name=b  n=2  x=-"]
    path = io.write_report(df, str(tmp_path), "coverage", "20260101_120000")
    assert path.endswith("coverage_20260101_120000.csv") and spark.read.option("header", True).csv(path).count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        io.write_report(df, str(tmp_path), "coverage", "20260101_120000")


def test_lines_of_split_label_files_keep_their_order(spark, tmp_path):
    rows = [f"{i % 700},{i % 2},reason {i}" for i in range(4000)]
    (tmp_path / "batch_1_result.csv").write_text("pair_id,verdict,reason\n" + "\n".join(rows) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        df = io.read_results(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 4
        got = [r.reason for r in df.orderBy("line").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"reason {i}" for i in range(4000)]


def test_numbers_are_gapless_and_in_order(spark):
    rng = random.Random(1)
    rows = [(t, r) for t in range(30) for r in range(1, rng.randint(2, 9))]
    rng.shuffle(rows)
    got = ranking.numbered(spark.createDataFrame(rows, "term_id long, rank int").repartition(5), "term_id", "rank").orderBy("pair_id").collect()
    assert [(r.term_id, r["rank"]) for r in got] == sorted(rows) and [r.pair_id for r in got] == list(range(len(rows)))


def test_ndcg_and_ranker(spark):
    rng = random.Random(2)
    rows = []
    for g in range(80):
        for i in range(12):
            x, y = rng.random(), rng.random()
            rows.append((g, i, int(x + 0.1 * rng.random() > 0.75), x, y))
    df = spark.createDataFrame(rows, "g long, i long, label int, x double, y double")

    def plain(score, k):
        out = []
        for g in range(80):
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-score(r), r[1]))
            best = sorted(mine, key=lambda r: -r[2])
            dcg = lambda rs: sum(1 / math.log2(p + 2) for p, r in enumerate(rs[:k]) if r[2])
            if any(r[2] for r in mine):
                out.append(dcg(mine) / dcg(best))
        return sum(out) / len(out)

    got = {r.k: r.ndcg for r in ranking.ndcg(df, "g", "label", [3, 5], F.col("y").desc(), F.col("i")).collect()}
    assert got == {k: pytest.approx(plain(lambda r: r[4], k)) for k in (3, 5)}
    model = ranking.ranker(df, ["x", "y"], "label", "g", "i", "y")
    after = {r.k: r.ndcg for r in ranking.ndcg(ranking.rank_scores(df, model, ["x", "y"]), "g", "label", [3, 5], F.col("score").desc(), F.col("i")).collect()}
    assert all(after[k] > 0.95 > got[k] for k in (3, 5))


def test_draws_skip_the_block_and_fill_from_thin_pools(spark):
    """Three of 400 items of a brand lie in another category: every positive still gets one, and never one of its own category."""
    items = [(i, "main" if i >= 3 else "other", "b") for i in range(400)]
    df = spark.createDataFrame(items, "item_id long, main string, brand string")
    positives = df.filter("item_id >= 100 and item_id < 160").select((F.col("item_id") + 1000).alias("term_id"), "item_id", "main", "brand")
    source = negatives.Source("s", {"brand": F.col("brand")}, block="main", own=F.col("main"), most=2)
    got = negatives.drawn(positives, df, [source], 42).collect()
    assert {r.item_id for r in got} == {0, 1, 2} and {r.pos_item for r in got} == set(range(100, 160))
    assert max(sum(r.pos_item == p for r in got) for p in range(100, 160)) <= 2


def test_pool_positions_are_gapless(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(1000)], "item long, k int").repartition(6)
    got = relational.numbered_pool(df, ["k"], "item").collect()
    for k in range(3):
        assert sorted(r.position for r in got if r.k == k) == list(range(sum(r.k == k for r in got)))
    assert {r.pool_size for r in got} == {334, 333}


def test_contained_equals_trying_all(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abç ") for _ in range(n))
    texts, needles = [(i, word(rng.randint(0, 14))) for i in range(60)] + [(99, None)], sorted({word(rng.randint(0, 5)) for _ in range(60)}) + [None]
    got = relational.contained(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(n,) for n in needles], "n string"), "id", "t", "n").collect()
    assert sorted((r.id, r.n) for r in got) == sorted((i, n) for i, t in texts for n in needles if t is not None and n and n in t)


def test_stream_state_can_be_bounded(spark, tmp_path):
    from quarry.streaming import labels

    folder = tmp_path / "labels"
    folder.mkdir()
    (folder / "batch_1_result.csv").write_text("pair_id,verdict,reason\n1,1,a\n2,0,b\n1,0,c\nx,1,d\n")
    (folder / "batch_2_result.csv").write_text("pair_id,verdict,reason\n2,1,e\n3,1,f\n")
    stream = labels.first_verdicts(labels.read_label_stream(spark, str(folder), 1), "1 day")
    q = stream.writeStream.format("memory").queryName("bounded").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.pair_id for r in spark.sql("SELECT pair_id FROM bounded").collect()) == [1, 2, 3]
