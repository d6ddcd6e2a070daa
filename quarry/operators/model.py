"""Grouped folds, boosted trees, out-of-fold scores, and gates. Encoders and language models enter as score or vector columns."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.evaluate import best_threshold, sweep
from quarry.operators.relational import draw
from quarry.sources import io


def fold_of(key: str, folds: int = 5, seed: int = 42) -> Column:
    """All rows of a key in one fold."""
    return (draw(seed, key) % folds).cast("int")


def balanced_folds(sizes: list[tuple[str, int]], folds: int = 5) -> dict[str, int]:
    """Largest group first, each into the smallest fold; ties by key, then by fold. For tables of groups that fit on the driver."""
    load, out = [0] * folds, {}
    for key, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        f = min(range(folds), key=lambda i: (load[i], i))
        out[key] = f
        load[f] += n
    return out


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """With ``weight``: n / (2 x rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"))
    return df.join(F.broadcast(counts.crossJoin(F.broadcast(total))), label).withColumn("weight", F.col("_t") / (2 * F.col("_n"))).drop("_n", "_t")  # two rows


def oof_scores(
    df: DataFrame, features: list[str], label: str, group: str, categorical: list[str] | None = None, folds: int = 5, iterations: int = 10, depth: int = 4, seed: int = 42,
    stored: bool = False,
) -> tuple[DataFrame, list]:
    """(df with ``fold`` and ``score``, models): each row scored by the trees that never saw its group.

    One fold of the training rows serves for early stopping, if there are more than two folds. The rows are worked out once and written, as every
    fold reads them several times; ``stored``: they already are. The trees train on rows that are equal in all they see as one row of their
    summed weight, which gives every split the same gain. Features are averaged over models by ``importances``.
    """
    cats = categorical or []
    df = df if stored else io.written(df, "oof")
    data = class_weight(df, label).withColumn("fold", fold_of(group, folds, seed)).withColumn("label", F.col(label).cast("double"))
    if cats:
        data = StringIndexer(inputCols=cats, outputCols=[f"{c}_ix" for c in cats], stringOrderType="alphabetAsc", handleInvalid="keep").fit(data).transform(data)
    seen = [*features, *[f"{c}_ix" for c in cats]]
    alike = data.groupBy("fold", "label", *seen).agg((F.first("weight") * F.count("*")).alias("weight"))  # a label has one weight
    vectors = VectorAssembler(inputCols=seen, outputCol="_x", handleInvalid="keep")
    data, alike = vectors.transform(data), vectors.transform(io.written(alike, "alike"))
    out, models = None, []
    for f in range(folds):
        train = alike.filter(F.col("fold") != f).withColumn("_stop", (F.col("fold") == (f + 1) % folds) if folds > 2 else F.lit(False))
        gbt = GBTClassifier(featuresCol="_x", labelCol="label", weightCol="weight", validationIndicatorCol="_stop", maxIter=iterations, maxDepth=depth, maxBins=64, seed=seed)
        model = gbt.fit(train)
        models.append(model)
        part = model.transform(data.filter(F.col("fold") == f)).select(*df.columns, "fold", vector_to_array("probability")[1].alias("score"))
        out = part if out is None else out.unionByName(part)
    return out, models


def importances(models: list, features: list[str]) -> list[tuple[str, float]]:
    """Mean importance of each feature over the models, largest first."""
    mean = [sum(float(m.featureImportances[i]) for m in models) / len(models) for i in range(len(features))]
    return sorted(zip(features, mean, strict=True), key=lambda x: (-x[1], x[0]))


def gates(oof_f1: float, reference_f1: float, top_share: float, jump: float = 0.02, share: float = 0.3) -> list[str]:
    """What looks too good to be true: a jump of the out-of-fold score, or one feature that carries the model."""
    out = []
    if oof_f1 - reference_f1 > jump:
        out.append(f"out-of-fold score rose by {oof_f1 - reference_f1:.3f}")
    if top_share > share:
        out.append(f"one feature has {top_share:.0%} of the importance")
    return out


def distill(known: DataFrame, missing: DataFrame, features: list[str], label: str, group: str, least_f1: float = 0.88, write: bool = False, stored: bool = False) -> tuple[float, DataFrame | None]:
    """(macro-F1 out of fold, verdicts for ``missing``): verdicts only if the score reaches the gate and ``write`` is set.

    One job trains; the verdicts are the mean of the folds' models at the best out-of-fold threshold. ``stored``: both tables are read from files and need not be written.
    """
    scored, models = oof_scores(known, features, label, group, folds=3, iterations=5, stored=stored)
    best = best_threshold(sweep(scored, label, "score", 20, 90, 100), last=True).first()
    if best is None or best.macro_f1 < least_f1 or not write:
        return (best.macro_f1 if best else 0.0), None
    x = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(missing)
    total = F.lit(0.0)
    for i, m in enumerate(models):
        x = m.setProbabilityCol(f"_p{i}").setPredictionCol(f"_y{i}").setRawPredictionCol(f"_r{i}").transform(x)
        total = total + vector_to_array(f"_p{i}")[1]
    return best.macro_f1, x.select(*missing.columns, ((total / len(models)) >= best.threshold).cast("int").alias("verdict"))
