"""What a model trains on is worked out once."""

from pyspark.sql import functions as F

from quarry.functions import signals
from quarry.functions.lexicon import whole_word
from quarry.operators import model


def test_folds_share_one_evaluation_of_the_rows(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return float(x % 7)

    df = spark.range(200).select((F.col("id") % 20).alias("g"), (F.col("id") % 2).cast("int").alias("label"), F.udf(count, "double")("id").alias("x"), (F.col("id") % 3).cast("string").alias("kind"))
    scored, models = model.oof_scores(df, ["x"], "label", "g", ["kind"], folds=3, iterations=2, depth=2)
    assert scored.count() == 200 and scored.select("g", "fold").distinct().count() == 20 and len(models) == 3
    assert seen.value == 200


def test_equal_rows_train_as_one(spark, monkeypatch):
    """Rows that the trees can't tell apart come as one of their summed weight, and the scores stay those of all rows."""
    df = spark.range(400).select((F.col("id") % 20).alias("g"), (F.col("id") % 5 < 2).cast("int").alias("label"), (F.col("id") % 7).cast("double").alias("x")).withColumn("x", F.col("x") + F.col("label") * 2)
    sizes, fit = [], model.GBTClassifier.fit
    monkeypatch.setattr(model.GBTClassifier, "fit", lambda self, rows: (sizes.append(rows.count()), fit(self, rows))[1])
    scored, models = model.oof_scores(df, ["x"], "label", "g", folds=3, iterations=2, depth=2)
    assert len(sizes) == 3 and max(sizes) <= 28  # in two folds at most 7 values of x for a label
    data = model.class_weight(df, "label").withColumn("fold", model.fold_of("g", 3)).withColumn("label", F.col("label").cast("double"))
    rows = model.VectorAssembler(inputCols=["x"], outputCol="_x").transform(data)
    for f, m in enumerate(models):
        whole = fit(model.GBTClassifier(featuresCol="_x", labelCol="label", weightCol="weight", validationIndicatorCol="_stop", maxIter=2, maxDepth=2, maxBins=64, seed=42), rows.filter(F.col("fold") != f).withColumn("_stop", F.col("fold") == (f + 1) % 3))
        side = lambda x: {r.x: r.p for r in x.transform(rows).select("x", model.vector_to_array("probability")[1].alias("p")).distinct().collect()}
        a, b = side(m), side(whole)
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_words_are_named_as_by_their_pattern(spark):
    texts = ["", "erkek", "erkekler", "x erkek-y", "kadınbayan bayan", "kadının", "bebek", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for words in (("erkek",), ("kadın", "bayan"), ("bebek", "bebekler")):
        a, b = signals.named(F.col("t"), *words), F.col("t").rlike(whole_word(*words))
        assert df.filter(~a.eqNullSafe(b)).count() == 0
