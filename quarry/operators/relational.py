"""Joins, set operations, ranks within groups, and samples that are the same at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def decorate(pairs: DataFrame, terms: DataFrame, items: DataFrame, fill: str = "unknown") -> DataFrame:
    """Pairs with their term and item, missing text columns filled. Spark broadcasts a side if its statistics allow."""
    out = pairs.join(terms, "term_id", "left").join(items, "item_id", "left")
    text = [c for c, t in out.dtypes if t == "string" and c not in pairs.columns]
    return out.fillna(fill, text)


def lookup(left: DataFrame, table: DataFrame, key: str, default: dict) -> DataFrame:
    """Left join with defaults for keys that the table lacks."""
    return left.join(table, key, "left").fillna(default)


def unseen(pairs: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    return pairs.join(known.select(*keys).distinct(), list(keys), "left_anti")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first in an explicit order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def union_by_priority(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """All sources without rows whose key an earlier source holds, in one pass."""
    parts = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    rest = [F.col(c) for c in out.columns if c not in keys and c != "_source"]
    return first_by(out, keys, F.col("_source"), *rest).drop("_source")


def top_k(df: DataFrame, group: str, k: int | Column, *order: Column) -> DataFrame:
    """The first k rows of each group with their ``rank``. A number k lets Spark cut before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def top_share(df: DataFrame, group: str, share: float, *order: Column) -> DataFrame:
    """The first max(1, share x n) rows of each group, half to even."""
    k = F.greatest(F.lit(1), F.bround(F.lit(share) * F.count("*").over(W.partitionBy(group)))).cast("int")
    return df.withColumn("_k", k).withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter("rank <= _k").drop("_k")


def rank_band(df: DataFrame, group: str, low: int, high: int, *order: Column) -> DataFrame:
    return top_k(df, group, high, *order).filter(F.col("rank") >= low)


def after_exclusion(df: DataFrame, known: DataFrame, group: str, keys: list[str], cut: int, keep: int, *order: Column) -> DataFrame:
    """Cut at ``cut`` ranks, drop known keys, keep the first ``keep`` of what is left."""
    return top_k(unseen(top_k(df, group, cut, *order).drop("rank"), known, *keys), group, keep, *order)


def group_statistics(df: DataFrame, group: str, score: str) -> DataFrame:
    """Within each group: percent rank (average rank / n), z-score (a single row or no spread: 1e-8), ratio to the maximum, min-max."""
    w, s = W.partitionBy(group), F.col(score)
    ties = F.count("*").over(W.partitionBy(group, score))
    n = F.count("*").over(w)
    spread = F.coalesce(F.stddev_samp(s).over(w), F.lit(1e-8))
    low, high = F.min(s).over(w), F.max(s).over(w)
    return df.select(
        "*",
        ((F.rank().over(w.orderBy(s)) + (ties - 1) / 2) / n).alias("pct"),
        ((s - F.avg(s).over(w)) / F.greatest(spread, F.lit(1e-8))).alias("z"),
        high.alias("group_max"),
        (s / F.greatest(high, F.lit(1e-8))).alias("to_max"),
        F.coalesce(F.try_divide(s - low, high - low), F.lit(0.0)).alias("minmax"),
    )


def draw(seed: int | str, *keys: str) -> Column:
    """A number that depends on the seed and the keys only: the first 32 bits of an md5, the same in every engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def sample(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows (all, if fewer) in the order of their draws; ties by key."""
    return df.orderBy(draw(seed, *keys), *keys).limit(n)


def sample_groups(df: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """All rows of n drawn groups."""
    return df.join(sample(df.select(group).distinct(), n, seed, group), group, "left_semi")


def stratified(df: DataFrame, strata: list[tuple[str, Column, int]], seed: int, key: str) -> DataFrame:
    """Strata in order of precedence: (name, condition, rows). A row enters one stratum; a later one draws from what is left."""
    parts, left = [], df
    for name, condition, n in strata:
        part = sample(left.filter(condition), n, seed, key).withColumn("stratum", F.lit(name))
        parts.append(part)
        left = left.join(part.select(key), key, "left_anti")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rare_and_fill(df: DataFrame, rare: Column, n: int, seed: int, key: str) -> DataFrame:
    """All rare rows, and drawn others up to n in total."""
    few = df.filter(rare)
    return few.unionByName(sample(df.filter(~rare), max(0, n - few.count()), seed, key))


def range_of(key: str) -> Column:
    """One of 256 ranges of an md5 of the key, the same in every engine; a hot pool is numbered range by range."""
    return F.substring(F.md5(F.col(key).cast("string")), 1, 2)


def numbered_pool(pool: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The pool with each row's ``position`` (from 0, by range of ``order`` and ``order``) in its key, and the key's ``pool_size``."""
    rows = pool.withColumn("_b", range_of(order))
    counts = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    w = W.partitionBy(*keys)
    counts = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_n").over(w).alias("pool_size"))
    own = rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(order)) - 1)
    return own.join(counts, [*keys, "_b"]).withColumn("position", F.col("_start") + F.col("_r")).drop("_b", "_r", "_start")


def contained(texts: DataFrame, needles: DataFrame, key: str, text: str, needle: str, prefix: int = 3) -> DataFrame:
    """(key, needle): which needles each text contains, as an equality join.

    A needle is keyed by its first ``prefix`` characters (all, if it has fewer); a text offers the beginnings at each of its positions.
    What meets is compared in full. Nothing is broadcast and no text is tried against every needle. Null and empty needles are in no text.
    """
    t, n = F.col(text), F.col(needle)
    keyed = needles.select(needle).filter(F.length(n) > 0).distinct().withColumn("_k", F.substring(n, 1, prefix))
    starts = texts.select(key, text, F.explode(F.sequence(F.lit(1), F.length(t))).alias("_p")).filter(F.length(t) > 0)
    rest = starts.select(key, F.substring(t, F.col("_p"), F.length(t)).alias("_rest"))
    offers = rest.select(key, "_rest", F.explode(F.array_distinct(F.array(*[F.substring("_rest", 1, i) for i in range(1, prefix + 1)]))).alias("_k"))
    return offers.join(keyed, "_k").filter(F.startswith("_rest", needle)).select(key, needle).distinct()


def consume(pool: DataFrame, takers: DataFrame, group: str, each: int, pool_order: list[Column], taker_order: list[Column]) -> DataFrame:
    """Within a group, the first taker gets the first ``each`` rows of the pool, the next taker the next ones."""
    p = pool.withColumn("_slot", F.row_number().over(W.partitionBy(group).orderBy(*pool_order)) - 1)
    t = takers.withColumn("_taker", F.row_number().over(W.partitionBy(group).orderBy(*taker_order)) - 1)
    return p.withColumn("_taker", F.floor(F.col("_slot") / each).cast("int")).join(t, [group, "_taker"]).drop("_slot", "_taker")
