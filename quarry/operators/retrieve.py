"""Dense retrieval, neighbour transfer, candidate sets and label merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.relational import first_by, top_k, unseen

#: A query side of at most so many rows is sent to all executors; a larger one is cut into blocks of this size.
BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, added in order; null if either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def pair_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with the inner product of their vectors (a, va) and (b, vb); 0 where one is missing."""
    out = pairs.join(left.select(a, F.col("vec").alias("_va")), a, "left").join(right.select(b, F.col("vec").alias("_vb")), b, "left")
    return out.withColumn("cosine", F.coalesce(dot(F.col("_va"), F.col("_vb")), F.lit(0.0))).drop("_va", "_vb")


def dense_top_k(queries: DataFrame, items: DataFrame, k: int, within: DataFrame | None = None) -> DataFrame:
    """(query_id, item_id, score, rank) of the k largest inner products; ties to the smaller item.

    queries (query_id, qv), items (item_id, vec). Every query is compared with every item exactly. The item side stays where it
    is; blocks of queries of bounded size are sent to it, and each block is cut to k rows a query before its shuffle. ``within``
    (query_id, item_id): only these pairs. Rows without a vector take no part.
    """
    if within is not None:
        scored = within.join(queries, "query_id").join(items, "item_id").select("query_id", "item_id", dot(F.col("qv"), F.col("vec")).alias("score"))
        return top_k(scored, "query_id", k, F.col("score").desc(), F.col("item_id"))
    queries, items = queries.filter("qv is not null"), items.filter("vec is not null").select("item_id", "vec")
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    kinds, found = dict(queries.dtypes)["query_id"], None
    for i in range(blocks):
        part = (queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).select("query_id", "qv").toArrow()  # bounded: about BLOCK rows
        got = items.mapInArrow(_products(part, k), f"query_id {kinds}, item_id {dict(items.dtypes)['item_id']}, score double")
        found = got if found is None else found.unionByName(got)
    return top_k(found, "query_id", k, F.col("score").desc(), F.col("item_id"))


def _products(queries, k: int):
    """For batches of (item_id, vec): the k best items of each query in the batch, by one matrix product."""
    import numpy as np
    import pyarrow as pa

    names = queries.column("query_id").combine_chunks()
    asks = np.array(queries.column("qv").to_pylist(), np.float64).reshape(len(names), -1)

    def run(batches):
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            score = np.round(asks @ flat.reshape(batch.num_rows, -1).T, 9)
            edge = max(0, batch.num_rows - k)
            last = np.partition(score, edge, axis=1)[:, edge]
            hit, ids = score >= last[:, None], np.array(batch.column(0).to_pylist())
            for j in np.flatnonzero(hit.sum(1) > k):  # ties at the k-th place: the smaller items
                at = np.flatnonzero(hit[j])
                hit[j, at[np.lexsort((ids[at], -score[j, at]))[k:]]] = False
            q, i = np.nonzero(hit)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), batch.column(0).take(pa.array(i)), pa.array(score[q, i])], names=["query_id", "item_id", "score"])

    return run


def transfer(neighbours: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
    """(query_id, item_id, score): what a query's neighbours (query_id, term_id, sim) know as positives; max, sum or count."""
    agg = {"max": F.max("sim"), "sum": F.sum("sim"), "count": F.count("*").cast("double")}[how]
    return neighbours.join(pairs.select("term_id", "item_id"), "term_id").groupBy("query_id", "item_id").agg(agg.alias("score"))


def shared_items(pairs: DataFrame) -> DataFrame:
    """(term_id, other, n): terms that have n items in common.

    An item of m terms gives m x (m - 1) pairs, as each of them is a result; filter on term_id to ask for some terms, the filter reaches
    the join's input. Counts are partial before the shuffle, and Spark splits a popular item, as the join is skewed.
    """
    p = pairs.select("term_id", "item_id").distinct()
    return p.join(p.withColumnRenamed("term_id", "other"), "item_id").filter("term_id <> other").groupBy("term_id", "other").agg(F.count("*").alias("n"))


def candidates(ranked: DataFrame, known: DataFrame, cut: int, keep: int) -> DataFrame:
    """Of the first ``cut`` ranks those that are not known, ``keep`` a query."""
    left = unseen(ranked.filter(F.col("rank") <= cut), known, "query_id", "item_id")
    return left.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).filter(F.col("place") <= keep)


def outside(chosen: DataFrame, pool: DataFrame, *keys: str) -> int:
    """How many chosen rows are not in the pool; it must be 0."""
    return unseen(chosen, pool, *keys).count()


def merge_labels(results: DataFrame, candidates_: DataFrame) -> DataFrame:
    """(term_id, item_id, label, src): valid verdicts 0 or 1, the first file's one of each pair_id, joined to its pair.

    results: pair_id, verdict, file, line as text; rows whose numbers can't be read are dropped.
    """
    rows = results.select(F.expr("try_cast(pair_id AS bigint)").alias("pair_id"), F.expr("try_cast(verdict AS int)").alias("verdict"), "file", "line")
    rows = first_by(rows.filter("pair_id IS NOT NULL AND verdict IN (0, 1)"), ["pair_id"], F.col("file"), F.col("line"))
    src = F.when(F.col("verdict") == 1, "llm_pos").otherwise("llm_neg")
    return rows.join(candidates_, "pair_id").select("term_id", "item_id", F.col("verdict").alias("label"), src.alias("src"))


def regime_score(brand: Column, brand_conf: Column, cat_conf: Column, cat: Column, bm25: Column, knn: Column) -> Column:
    """Weights switch with what the query says: a sure brand, a sure category, or neither."""
    return (
        F.when(brand_conf > 0.4, 4.0 * brand + 1.5 * cat + 1.0 * bm25 + 0.5 * knn)
        .when(cat_conf > 0.5, 2.0 * cat + 2.0 * bm25 + 1.0 * knn)
        .otherwise(0.5 * cat + 1.5 * bm25 + 2.0 * knn)
    )


def blend_score(best_knn: Column, knn: Column, cat: Column, overlap: Column) -> Column:
    return F.when(best_knn > 0, 0.5 * knn + 0.35 * cat + 0.15 * overlap).otherwise(0.55 * cat + 0.45 * overlap)


def transfer_score(t: Column, overlap: Column, brand: Column, has_brand: Column) -> Column:
    return F.when(t > 0.1, 3.0 * t + 0.5 * overlap + 2.0 * brand).when(has_brand & (brand > 0.5), 2.5 * brand + overlap).otherwise(overlap + 0.1 * t)


def adaptive_blend(group: str, knn: str, cosine: str) -> Column:
    """alpha x knn / max + (1 - alpha) x min-max cosine, alpha = min(0.75, 0.15 + 0.6 x share of the group with knn > 0)."""
    w = W.partitionBy(group)
    alpha = F.least(F.lit(0.75), 0.15 + 0.6 * F.avg((F.col(knn) > 0).cast("double")).over(w))
    k = F.coalesce(F.try_divide(F.col(knn), F.max(knn).over(w)), F.lit(0.0))
    low, high = F.min(cosine).over(w), F.max(cosine).over(w)
    c = F.coalesce(F.try_divide(F.col(cosine) - low, high - low), F.lit(0.0))
    return alpha * k + (1 - alpha) * c


def with_fallback(knn: Column, cosine: Column) -> Column:
    return F.when(knn > 0, knn).otherwise(0.001 * cosine)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def mean_of(scores: list[DataFrame], keys: list[str], weights: list[float] | None = None) -> DataFrame:
    """Weighted mean of score tables (keys, score), joined by their keys."""
    weights = weights or [1.0] * len(scores)
    out, total = None, F.lit(0.0)
    for i, (s, w) in enumerate(zip(scores, weights, strict=True)):
        part = s.select(*keys, F.col("score").alias(f"_s{i}"))
        out = part if out is None else out.join(part, keys)
        total = total + F.col(f"_s{i}") * w
    return out.select(*keys, (total / sum(weights)).alias("score"))
