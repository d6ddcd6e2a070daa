"""Properties and brute force of operators that SQL doesn't cover, and of sources and streams."""

import random

from pyspark.sql import functions as F

from quarry.operators import evaluate, model, negatives, relational, retrieve
from quarry.plans.adapters import Tables
from quarry.plans.models import decorated
from quarry.sources import io

DIR = "/root/testdata/sf0.001"


def test_negatives_are_new_and_bounded(spark):
    t = Tables(spark, DIR)
    p, i = decorated(t)
    n = negatives.negatives(p, i, negatives.rule_sources(), 5, 42).cache()
    assert n.join(t.pairs, ["term_id", "item_id"], "left_semi").count() == 0
    assert n.count() == n.select("term_id", "item_id").distinct().count() <= 5 * t.pairs.count()
    assert n.select("src").distinct().count() == 7
    again = negatives.negatives(p.repartition(7), i.repartition(3), negatives.rule_sources(), 5, 42)
    assert n.exceptAll(again).isEmpty() and again.exceptAll(n).isEmpty()


def test_sweep_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), rng.random()) for _ in range(500)]
    got = {round(r.threshold, 6): r.macro_f1 for r in evaluate.sweep(spark.createDataFrame(rows, "y int, s double"), "y", "s", 20, 90, 100).collect()}
    for k in range(20, 91):
        tp = sum(y == 1 and s >= k / 100 for y, s in rows)
        fp = sum(y == 0 and s >= k / 100 for y, s in rows)
        fn = sum(y == 1 for y, _ in rows) - tp
        tn = len(rows) - tp - fp - fn
        f1 = lambda a, b, c: 2 * a / (2 * a + b + c) if a + b + c else 0
        assert abs(got[k / 100] - (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2) < 1e-12


def test_auc_with_ties_and_one_score(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), rng.randint(0, 9) / 10) for _ in range(300)]
    got = evaluate.auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    raw = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(got.auc - max(raw, 1 - raw)) < 1e-12 and got.flipped == (raw < 0.5)
    assert evaluate.auc(spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, s double"), "y", "s").first().auc == 0.5


def test_folds_keep_groups_together(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("g"))
    assert df.select("g", model.fold_of("g").alias("f")).distinct().groupBy("g").count().filter("count > 1").isEmpty()
    folds = model.balanced_folds([(str(i), i) for i in range(1, 21)])
    sizes = [sum(i for i in range(1, 21) if folds[str(i)] == f) for f in range(5)]
    assert max(sizes) - min(sizes) <= 2


def test_dense_blocks_agree(spark, monkeypatch):
    e = spark.read.parquet(f"{DIR}/embeddings.parquet")
    q, i = e.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    whole = retrieve.dense_top_k(q, i, 5)
    monkeypatch.setattr(retrieve, "BLOCK", 7)
    assert whole.exceptAll(retrieve.dense_top_k(q, i, 5)).isEmpty()


def test_gates():
    assert model.gates(0.97, 0.96, 0.1) == []
    assert len(model.gates(0.99, 0.96, 0.5)) == 2


def test_result_files(spark, tmp_path):
    (tmp_path / "batch_001_result.csv").write_text("pair_id,verdict,reason\n1,1,a\nabc,1,x\n5,,y\n2,0,b\n")
    (tmp_path / "batch_002_result.csv").write_text("pair_id,verdict,reason\n1,0,later\n3,1,c\n")
    got = io.read_results(spark, str(tmp_path))
    assert sorted((r.pair_id, r.verdict, r.batch) for r in got.collect()) == [(1, 0, 2), (1, 1, 1), (2, 0, 1), (3, 1, 2)]
    pairs = spark.createDataFrame([(i, i * 10, i * 100) for i in range(1, 5)], "pair_id long, term_id long, item_id long")
    merged = retrieve.merge_labels(got.select(F.col("pair_id").cast("string").alias("pair_id"), F.col("verdict").cast("string").alias("verdict"), "file", "line"), pairs)
    assert sorted((r.term_id, r.label, r.src) for r in merged.collect()) == [(10, 1, "llm_pos"), (20, 0, "llm_neg"), (30, 1, "llm_pos")]
    missing = io.missing_batches(spark.range(1, 4).select(F.col("id").cast("int").alias("batch")), got)
    assert [r.batch for r in missing.collect()] == [3]


def test_csv_round_trip_and_missing_words(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b", c'), ("2", "NA"), ("3", None)], "term_id string, query string")
    io.write_csv(df, str(tmp_path / "t"))
    back = io.read_csv(spark, str(tmp_path / "t"), io.TERMS, ["term_id", "query"])
    assert sorted(back.collect(), key=lambda r: r.term_id) == [("1", 'a "b", c'), ("2", None), ("3", None)]


def test_cache_follows_content(spark, tmp_path):
    calls = []

    def make(df):
        calls.append(1)
        return df.groupBy().count()

    a, b = spark.range(10), spark.range(1, 11)
    for df in (a, a, b):
        io.cached(df, F.col("id"), str(tmp_path / "c"), make).collect()
    assert len(calls) == 2


def test_label_stream(spark, tmp_path):
    from quarry.streaming import labels

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "batch_001_result.csv").write_text("pair_id,verdict,reason\n1,1,a\n1,0,b\nx,1,c\n2,0,d\n")
    stream = labels.first_verdicts(labels.read_label_stream(spark, str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("labels_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(r.pair_id for r in spark.table("labels_out").collect()) == [1, 2]


def test_priority_union_is_order_independent(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    got = relational.union_by_priority([a, b], ["k"])
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, "x"), (2, "y"), (3, "w")]


def test_group_of_one(spark):
    r = relational.group_statistics(spark.createDataFrame([(1, 0.4)], "g int, s double"), "g", "s").first()
    assert (r.pct, r.z, r.minmax) == (1.0, 0.0, 0.0)
