"""Confusion counts, F1, thresholds, ranking coverage, AUC, and comparisons of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(truth: Column, guess: Column) -> list[Column]:
    c = lambda t, g, n: F.count_if((truth == t) & (guess == g)).alias(n)
    return [c(1, 1, "tp"), c(0, 1, "fp"), c(1, 0, "fn"), c(0, 0, "tn")]


def _f1(hit: Column, *missed: Column) -> Column:
    return F.coalesce(F.try_divide((2 * hit).cast("double"), (2 * hit + sum(missed[1:], missed[0])).cast("double")), F.lit(0.0))


def macro_f1(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Mean of both classes' F1; a class without members or guesses counts 0."""
    return (_f1(tp, fp, fn) + _f1(tn, fn, fp)) / 2


def macro_f1_present(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Mean over the classes that occur in truth or guess."""
    one, zero = tp + fp + fn > 0, tn + fn + fp > 0
    return (F.when(one, _f1(tp, fp, fn)).otherwise(0.0) + F.when(zero, _f1(tn, fn, fp)).otherwise(0.0)) / (one.cast("int") + zero.cast("int"))


def per_group(df: DataFrame, group: str, truth: str, guess: str) -> DataFrame:
    """group, tp, fp, fn, tn, precision, recall, f1 (positive class), macro_f1 over present classes."""
    g = df.groupBy(group).agg(*confusion(F.col(truth), F.col(guess)))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return g.select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), _f1(tp, fp, fn).alias("f1"), macro_f1_present(tp, fp, fn, tn).alias("macro_f1"))


def sweep(df: DataFrame, truth: str, score: str, low: int, high: int, scale: int) -> DataFrame:
    """(threshold, macro_f1, positives) for low/scale, (low + 1)/scale, ... high/scale; score >= threshold is a positive.

    One pass buckets each score by the thresholds it reaches; sums over the buckets from the top give every threshold's counts.
    The sums run over a table of (high - low + 2) rows.
    """
    bucket = F.least(F.greatest(F.floor(F.round(F.col(score) * scale, 9)).cast("int"), F.lit(low - 1)), F.lit(high))
    per = df.groupBy(bucket.alias("b")).agg(F.sum(F.col(truth)).alias("p"), F.count("*").alias("n"))
    grid = df.sparkSession.range(low - 1, high + 1).select(F.col("id").cast("int").alias("b")).join(per, "b", "left").fillna(0, ["p", "n"])
    down = W.orderBy(F.col("b").desc()).rowsBetween(W.unboundedPreceding, 0)
    total = W.partitionBy()
    tp, at = F.sum("p").over(down), F.sum("n").over(down)
    p, n = F.sum("p").over(total), F.sum("n").over(total)
    out = grid.select("b", tp.alias("tp"), (at - tp).alias("fp"), (p - tp).alias("fn"), (n - at - p + tp).alias("tn"), at.alias("positives"))
    f1 = macro_f1(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return out.filter(F.col("b") >= low).select((F.col("b") / scale).alias("threshold"), f1.alias("macro_f1"), F.col("positives").cast("long").alias("positives"))


def best_threshold(swept: DataFrame, last: bool = False) -> DataFrame:
    """The threshold of the largest macro-F1: the first one on ties, or the last."""
    t = F.col("threshold")
    return swept.orderBy(F.round("macro_f1", 12).desc(), t.desc() if last else t).limit(1)


def threshold_by_count(swept: DataFrame, target: int) -> DataFrame:
    """The threshold whose number of positives is nearest to a target; the smaller one on ties."""
    return swept.orderBy(F.abs(F.col("positives") - target), "threshold").limit(1)


def auc(df: DataFrame, truth: str, score: str, ranges: int = 64) -> DataFrame:
    """(auc, flipped): rank statistic with average ranks; below 0.5 it is turned round.

    Distinct scores are counted first. Approximate quantiles cut them into ranges; running sums go within ranges and over the
    table of ranges, so that no task orders all scores. The result is exact wherever the cuts lie.
    """
    per = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(truth).alias("p"), F.count("*").alias("n"))
    cuts = per.agg(F.percentile_approx("s", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 1000).alias("cuts"))
    per = per.crossJoin(F.broadcast(cuts))  # one row
    per = per.select("s", "p", "n", F.size(F.filter("cuts", lambda c: c < F.col("s"))).alias("r"))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    zeros = F.col("n") - F.col("p")
    starts = per.groupBy("r").agg(F.sum(zeros).alias("_z")).select("r", F.coalesce(F.sum("_z").over(before(W.orderBy("r"))), F.lit(0)).alias("_start"))
    below = F.coalesce(F.sum(zeros).over(before(W.partitionBy("r").orderBy("s"))), F.lit(0)) + F.col("_start")
    wins = per.join(F.broadcast(starts), "r").select("p", "n", (F.col("p") * (below + zeros / 2.0)).alias("u"))  # one row a range
    got = wins.agg((F.sum("u") / (F.sum("p") * (F.sum("n") - F.sum("p")))).alias("raw"))
    return got.select(F.greatest("raw", 1 - F.col("raw")).alias("auc"), (F.col("raw") < 0.5).alias("flipped"))


def coverage_at_k(ranked: DataFrame, truth: DataFrame, ks: list[int], fixed: int = 14) -> DataFrame:
    """One row for each k: how much of (query_id, item_id) the first k ranks hold, and the best F1 that ``fixed`` choices could reach."""
    per = truth.groupBy("query_id").agg(F.count("*").alias("n_true"))
    hits = ranked.join(truth, ["query_id", "item_id"]).groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks])
    own = per.join(hits, "query_id", "left").fillna(0)
    long = own.select("query_id", "n_true", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks])).alias("x")).select("query_id", "n_true", "x.k", "x.hits")
    g = long.groupBy(F.col("k").alias("top_k")).agg(
        F.count("*").alias("n_queries"), F.sum("n_true").alias("total_true"), F.sum("hits").alias("hits"), F.count_if(F.col("hits") > 0).alias("any_hit"),
        F.count_if(F.col("hits") == F.col("n_true")).alias("full_hit"), F.count_if(F.col("hits") == 0).alias("zero_hit"), F.avg("hits").alias("avg_hits"),
        F.median("hits").alias("median_hits"), F.sum(F.least(F.col("hits"), F.lit(fixed))).alias("_tp"),
    )
    precision, recall = F.col("_tp") / (F.col("n_queries") * fixed), F.col("_tp") / F.col("total_true")
    return g.select("*", (F.col("hits") / F.col("total_true")).alias("pair_coverage"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("oracle_f1")).drop("_tp")


def flips(a: DataFrame, b: DataFrame, keys: list[str], by: Column, name: str) -> DataFrame:
    """By group: predictions that went 0 -> 1, 1 -> 0, both, and the net change."""
    j = a.select(*keys, F.col("pred").alias("_a"), by.alias(name)).join(b.select(*keys, F.col("pred").alias("_b")), keys)
    up, down = F.count_if((F.col("_a") == 0) & (F.col("_b") == 1)), F.count_if((F.col("_a") == 1) & (F.col("_b") == 0))
    return j.groupBy(name).agg(up.alias("up"), down.alias("down"), (up + down).alias("flips"), (up - down).alias("net"), F.count("*").alias("n"))


def histogram(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """(bin, low, n): bins closed on the left; values outside the edges are left out."""
    bin_ = F.lit(-1)
    for e in edges:
        bin_ = bin_ + (value >= e).cast("int")
    kept = df.select(bin_.alias("bin"), value.alias("v")).filter((F.col("bin") >= 0) & (F.col("v") < edges[-1]))
    lows = F.array(*[F.lit(float(e)) for e in edges])
    return kept.groupBy("bin").agg(F.count("*").alias("n")).select("bin", F.get(lows, F.col("bin")).alias("low"), "n")


def profile(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """(feature, value of the group, mean) in long form."""
    means = df.groupBy(group).agg(*[F.avg(f).alias(f) for f in features])
    return means.select(group, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean")) for f in features])).alias("x")).select(group, "x.feature", "x.mean")


def missing(df: DataFrame) -> DataFrame:
    """(column, n_missing, share): nulls of each column in one pass."""
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = one.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in df.columns])).alias("x"))
    return long.select("x.column", "x.n_missing", F.coalesce(F.try_divide(F.col("x.n_missing").cast("double"), F.col("_n").cast("double")), F.lit(0.0)).alias("share"))
