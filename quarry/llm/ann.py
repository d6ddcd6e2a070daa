"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are brought to unit length, where the largest cosine is the least distance. Each of TABLES tables hashes a vector with
Gaussian (2-stable) projections, made orthogonal within a table and cut into cells of width WIDTH; their number grows with the
logarithm of the number of entries, so that buckets stay small. A query visits the perturbed buckets of each table in the
order of their estimated chance to hold a neighbour, until the visited ones hold it with probability COVER. The chance of a cell
is that of a normal step with the scale of the distance to a k-th neighbour, which SAMPLE queries compared with every entry give.
Queries whose own k-th hit is farther than that probe again, with the distance of that hit as their scale. Buckets are dealt
to groups; each group reranks the merged candidates of a query exactly and hands on its k best. A bucket with more than
BUCKET vectors is split over several groups, all of which its queries visit, so nothing is cut off.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm.common import materialize, sliced

TABLES, WIDTH, COVER = 16, 2.5, 0.14
#: Hash functions of a table for each doubling of the number of entries, and at least.
HASHES_PER_BIT, LEAST_HASHES = 0.62, 6
#: Queries that are compared with every entry to find the distance scale.
SAMPLE = 64
BUCKET, GROUP_ROWS, GROUPS = 5000, 20_000, 128
SPAN = 4
QUERY_BLOCK = 16_384
#: Tables of split buckets are broadcast up to this many rows.
HEAVY_ROWS = 200_000


@dataclass
class Tables:
    """The hash functions: fixed by the seed, the dimension and the number of entries."""

    dim: int
    entries: int
    seed: int = 17

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        hashes = max(LEAST_HASHES, round(HASHES_PER_BIT * math.log2(max(2, self.entries))))
        turn = lambda: np.linalg.qr(rng.normal(size=(self.dim, self.dim)))[0]
        blocks = -(-hashes // self.dim)  # more functions than dimensions: several turns
        self.a = np.stack([np.concatenate([turn() for _ in range(blocks)])[:hashes] * math.sqrt(self.dim) for _ in range(TABLES)])
        self.b = rng.uniform(0, WIDTH, (TABLES, hashes))
        self.mix = rng.integers(1, 1 << 62, hashes, dtype=np.int64) | 1

    def places(self, unit: np.ndarray) -> np.ndarray:
        """Projections in units of the cell width: tables x vectors x hashes."""
        return (np.einsum("thd,nd->tnh", self.a, unit) + self.b[:, None]) / WIDTH

    def key(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells.astype(np.int64) * self.mix).sum(-1)

    def probes(self, place: np.ndarray, scale: float) -> list[tuple[int, ...]]:
        """Cells of one table in falling order of their chance, until COVER is reached; ``place`` has one value a hash."""
        cells, chance = [], []
        for z in place:
            near = np.arange(-SPAN, SPAN + 1) + math.floor(z)
            p = np.array([_normal((c + 1 - z) * WIDTH / scale) - _normal((c - z) * WIDTH / scale) for c in near])
            by = np.argsort(-p, kind="stable")
            cells.append(near[by].tolist())
            chance.append(np.log(np.maximum(p[by], 1e-300)).tolist())
        start = (0,) * len(cells)
        heap, seen, total, out = [(-sum(c[0] for c in chance), start)], {start}, 0.0, []
        while heap and total < COVER:
            cost, at = heapq.heappop(heap)
            total += math.exp(-cost)
            out.append(tuple(c[i] for c, i in zip(cells, at, strict=True)))
            for i in range(len(cells)):
                if at[i] < 2 * SPAN and (step := at[:i] + (at[i] + 1,) + at[i + 1 :]) not in seen:
                    seen.add(step)
                    heapq.heappush(heap, (cost + chance[i][at[i]] - chance[i][at[i] + 1], step))
        return out


def _normal(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component, and not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each query by cosine: query_id, rank, vec_id, score.

    ``is_query`` selects the query rows, for example ``col("vec_id") % 50 == 0``. A query finds every usable row but those
    with its own id; where the probes find fewer than k, it is compared with every entry, so fewer than k come back only if there
    are no more. Nearest first, ties to the smaller id.
    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null id. A query is
    compared with vectors of its own length; each length is searched apart. Repeated rows count once; of rows with one id and different
    vectors each is an entry, and the least of them is the query. Equal vectors share one index
    entry, so a very common vector costs no more than others. An empty table gives an empty result. Only the named columns are read.
    """
    kind = "float" if dict(vectors.dtypes)[vec_col] == "array<float>" else "double"  # single precision stays so until it is multiplied
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("_q"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    out = None
    for dim in sorted(r.n for r in rows.groupBy(F.size("embedding").alias("n")).count().collect()):  # bounded: lengths, not rows
        part = _search(rows.filter(F.size("embedding") == dim), dim, kind, k)
        out = part if out is None else out.unionByName(part)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _search(rows: DataFrame, dim: int, kind: str, k: int) -> DataFrame:
    """``nearest`` over usable rows (vec_id, embedding, _q) of one length."""
    import pyarrow as pa

    # equal vectors are one entry with their k + 1 smallest ids: a query that is one of them needs k others. Spark limits the
    # ranks before the shuffle, so a very common vector doesn't meet in one task.
    first = W.partitionBy("embedding").orderBy("vec_id")
    entries = (
        rows.select("vec_id", "embedding").distinct().withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k + 1)
        .groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    )
    entries = materialize(entries, "entries")
    asked = materialize(rows.filter("_q").groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "asked")
    tables = Tables(dim, entries.count())
    scale = _scale(entries, asked, dim, k)
    vector = f"array<{kind}>"

    def index(batches):
        for batch in sliced(batches):
            unit = _unit(_matrix(batch.column(0), dim))
            keys = tables.key(np.floor(tables.places(unit))).reshape(-1)
            again = pa.array(np.tile(np.arange(batch.num_rows), TABLES))
            number = np.repeat(np.arange(TABLES, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(keys), batch.column(0).take(again), batch.column(1).take(again)], names=["tab", "bucket", "embedding", "ids"])

    def probe(batches):
        for batch in sliced(batches):
            places = tables.places(_unit(_matrix(batch.column(1), dim)))
            scales, tab, bucket, row = batch.column(2).to_pylist(), [], [], []
            for t in range(TABLES):
                for i in range(batch.num_rows):
                    keys = tables.key(np.array(tables.probes(places[t, i], scales[i])))
                    tab.append(np.full(len(keys), t, np.int32))
                    bucket.append(keys)
                    row.append(np.full(len(keys), i))
            if row:
                ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))[np.concatenate(row)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tab)), pa.array(np.concatenate(bucket)), pa.array(ids)], names=["tab", "bucket", "query_id"])

    indexed = entries.mapInArrow(index, f"tab int, bucket long, embedding {vector}, ids array<long>")
    counts = indexed.groupBy("tab", "bucket").count()
    size = counts.agg(F.sum("count")).first()[0] or 0
    groups = max(GROUPS, -(-size // GROUP_ROWS))
    heavy = counts.filter(F.col("count") > BUCKET).select("tab", "bucket", F.ceil(F.col("count") / BUCKET).cast("int").alias("_parts"))
    heavy = materialize(heavy, "heavy")
    n_heavy = heavy.count()
    small = F.broadcast if n_heavy <= HEAVY_ROWS else (lambda df: df)
    split = lambda df: df.join(small(heavy), ["tab", "bucket"], "left") if n_heavy else df.withColumn("_parts", F.lit(1))
    group = lambda part: F.pmod(F.xxhash64("tab", "bucket", part), F.lit(groups)).cast("int").alias("_g")
    parts = F.coalesce("_parts", F.lit(1))
    stored = split(indexed).withColumn("_part", F.pmod(F.xxhash64("embedding"), parts).cast("int")).select(group(F.col("_part")), "tab", "bucket", "embedding", "ids")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            vec = _matrix(left.column("embedding"), dim)
            norm = np.linalg.norm(vec, axis=1)
            ids = left.column("ids").to_pylist()
            at: dict[tuple[int, int], list[int]] = {}
            for i, b in enumerate(zip(left.column("tab").to_pylist(), left.column("bucket").to_pylist(), strict=True)):
                at.setdefault(b, []).append(i)
            asks = _matrix(right.column("embedding"), dim)
            for q, query, visits in zip(right.column("query_id").to_pylist(), asks, right.column("visits").to_pylist(), strict=True):
                found = [at[b] for v in visits if (b := (v["tab"], v["bucket"])) in at]
                if not found:
                    continue
                rows = np.unique(np.concatenate(found))
                score = np.einsum("nd,d->n", vec[rows], query) / (norm[rows] * np.linalg.norm(query))
                edge = min(len(rows), (k + 1) * TABLES) - 1  # an entry can be there once for each table
                best = rows[score >= np.partition(score, len(score) - 1 - edge)[len(score) - 1 - edge]]
                of = dict(zip(rows.tolist(), score.tolist(), strict=True))
                near = sorted({(-of[i], v) for i in best.tolist() for v in ids[i] if v != q})[:k]
                out_q += [q] * len(near)
                out_v += [v for _, v in near]
                out_s += [-s for s, _ in near]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    def search(scaled: DataFrame) -> DataFrame:
        """The k best that the probes of (vec_id, embedding, scale) meet."""
        visits = (
            split(scaled.mapInArrow(probe, "tab int, bucket long, query_id long")).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
            .select(group(F.col("_part")), "query_id", F.struct("tab", "bucket").alias("b"))
            .groupBy("_g", "query_id").agg(F.collect_list("b").alias("visits"))
            .join(scaled.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
        )
        found = stored.groupBy("_g").cogroup(visits.groupBy("_g")).applyInArrow(rerank, "query_id long, vec_id long, score double")
        return materialize(_best(found, k), "found")

    workers = rows.sparkSession.sparkContext.defaultParallelism
    found = search(asked.repartition(4 * workers, "vec_id").withColumn("scale", F.lit(scale)))  # few small files, much work a row
    # a k-th hit beyond the scale: its distance bounds that of the k-th neighbour, so it is the query's own scale
    reach = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.sqrt(F.greatest(2 - 2 * F.min("score"), F.lit(0.0))).alias("scale"))
    far = asked.join(reach.filter((F.col("n") >= k) & (F.col("scale") > scale)), "vec_id").select("vec_id", "embedding", "scale").repartition(4 * workers, "vec_id")
    found = materialize(_best(found.unionByName(search(far)), k), "found")
    count = found.groupBy("query_id").count()
    short = asked.join(count.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").filter(F.coalesce("count", F.lit(0)) < k).select("vec_id", "embedding")
    blocks = -(-short.count() // QUERY_BLOCK)
    for i in range(blocks):  # the probes found fewer than k: these queries see every entry
        block = short.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).toArrow()
        found = found.unionByName(_exact(entries, block.column(0).to_pylist(), _matrix(block.column(1), dim), dim, k))
    return found if not blocks else _best(found, k)


def _scale(entries: DataFrame, asked: DataFrame, dim: int, k: int) -> float:
    """Median distance of SAMPLE queries, drawn by a hash, to their k-th neighbour among all entries."""
    some = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    if not some.num_rows:
        return 1.0
    near = _best(_exact(entries, some.column(0).to_pylist(), _matrix(some.column(1), dim), dim, k), k)
    last = near.groupBy("query_id").agg(F.sqrt(F.greatest(2 - 2 * F.min("score"), F.lit(1e-4))).alias("d"))
    return float(last.agg(F.percentile("d", 0.5)).first()[0] or 1.0)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k first of each query; an entry that several groups found counts once."""
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact(entries: DataFrame, queries: list[int], asks: np.ndarray, dim: int, k: int) -> DataFrame:
    """Every entry against a block of queries of bounded size; k rows a query leave each batch."""
    import pyarrow as pa

    length = np.linalg.norm(asks, axis=1)

    def run(batches):
        for batch in sliced(batches):
            vec, ids = _matrix(batch.column(0), dim), batch.column(1).to_pylist()
            norm = np.linalg.norm(vec, axis=1)
            rough = (vec / norm[:, None]) @ (asks / length[:, None]).T  # finds the candidates; their scores are computed as everywhere
            edge = max(0, len(vec) - k - 1)
            q_out, v_out, s_out = [], [], []
            for i, q in enumerate(queries):
                best = np.flatnonzero(rough[:, i] >= np.partition(rough[:, i], edge)[edge] - 1e-9)
                score = np.einsum("nd,d->n", vec[best], asks[i]) / (norm[best] * length[i])
                near = sorted((-x, v) for x, j in zip(score.tolist(), best.tolist(), strict=True) for v in ids[j] if v != q)[:k]
                q_out += [q] * len(near)
                v_out += [v for _, v in near]
                s_out += [-s for s, _ in near]
            yield pa.RecordBatch.from_arrays([pa.array(q_out, pa.int64()), pa.array(v_out, pa.int64()), pa.array(s_out, pa.float64())], names=["query_id", "vec_id", "score"])

    return entries.select("embedding", "ids").mapInArrow(run, "query_id long, vec_id long, score double").select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
