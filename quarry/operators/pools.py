"""Rule-based negatives where the catalogue fits a worker: the pools are arrays of places, a term's positives are worked out together.

The pairs are shuffled once, by term; draws, known pairs, repeats and ranks are then those of one term and need no further join. What a
pool holds is the same as in ``negatives.drawn``, and so are the draws.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

try:  # a third of the time of hashlib's for short texts
    from _md5 import md5
except ImportError:
    from hashlib import md5

#: Items up to which their pools go to every worker: some 4 bytes an item and pool, 8 an id.
ITEMS = 2_000_000
#: Positives of a term up to which they are worked out together; terms with more are joined with the pools.
POSITIVES = 100_000
#: Rows that are worked out at a time, whole terms.
ROWS = 20_000
WHOLE = ("tinyint", "smallint", "int", "bigint")


def fits(positives: DataFrame, items: DataFrame) -> bool:
    kinds = [dict(positives.dtypes)["term_id"], dict(positives.dtypes)["item_id"], dict(items.dtypes)["item_id"]]
    return all(k in WHOLE for k in kinds) and items.count() <= ITEMS


def many(known: DataFrame) -> DataFrame:
    """(term_id): terms of too many pairs."""
    return known.groupBy("term_id").agg(F.count("*").alias("n")).filter(F.col("n") > POSITIVES).select("term_id")


@dataclass
class Pool:
    """Pools of one source by key: ``order`` has the places of their items, one pool after the other, each in the order of block, range and id."""

    codes: list[dict[str, int]]  # a code for each value of each key column
    blocks: dict[str, int]
    keys: np.ndarray
    start: np.ndarray
    size: np.ndarray
    cells: np.ndarray  # key place x number of blocks + block
    cell_start: np.ndarray
    cell_size: np.ndarray
    order: np.ndarray

    def find(self, values: list) -> np.ndarray:
        """Place of the pool of each row, -1 where there is none. ``values``: a dictionary array for each key column."""
        if not len(self.keys):
            return np.full(len(values[0]) if values else 0, -1)
        key, there = np.int64(0), np.True_
        for code, v in zip(self.codes, values, strict=True):
            c = _coded(v, code)
            key, there = key * len(code) + c, there & (c >= 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(there & (self.keys[at] == key), at, -1)


def _coded(values, code: dict[str, int]) -> np.ndarray:
    """The code of each text of a dictionary array, -1 where it has none."""
    return np.array([code.get(x, -1) for x in values.dictionary.to_pylist()] + [-1], np.int64)[values.indices.to_numpy(zero_copy_only=False)]


def _pool(place: np.ndarray, turn: np.ndarray, keys: list, block) -> Pool:
    """``place`` of the items, in the order of which they are numbered in a block by ``turn``; texts as dictionary arrays."""
    codes = []
    key = np.zeros(len(place), np.int64)
    for k in keys:
        codes.append({x: n for n, x in enumerate(sorted(k.dictionary.to_pylist()))})
        key = key * len(codes[-1]) + _coded(k, codes[-1])
    blocks = {x: n for n, x in enumerate(sorted(block.dictionary.to_pylist()))} if block is not None else {"": 0}
    part = _coded(block, blocks) if block is not None else np.zeros(len(place), np.int64)
    own, key = np.unique(key, return_inverse=True)
    cell = key * len(blocks) + part
    order = np.lexsort((turn, cell))
    size = np.bincount(key, minlength=len(own))
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(own) else size
    cells, first, count = np.unique(cell[order], return_index=True, return_counts=True)
    return Pool(codes, blocks, own, start, size, cells, first - start[cells // len(blocks)], count, place[order].astype(np.int32))


def pools(items: DataFrame, sources: list) -> tuple[np.ndarray, list[list[Pool]]]:
    """(ids in order; for each source its pools, and those to fall back on)."""
    import pyarrow as pa

    from quarry.operators.relational import range_of

    names = sorted({k for s in sources for k in [*s.keys, *([s.block] if s.block else [])]})
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    got = items.filter(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("bigint").alias("item_id"), F.conv(range_of("item_id"), 16, 10).cast("int").alias("range"),
        *[text(F.col(n)).alias(f"k{i}") for i, n in enumerate(names)], *[F.coalesce(s.among, F.lit(False)).alias(f"a{i}") for i, s in enumerate(sources) if s.among is not None],
    ).toArrow()
    encoded = lambda col: pa.concat_arrays(col.chunks).dictionary_encode() if col.num_chunks else pa.array([], pa.string()).dictionary_encode()
    values = {n: encoded(got.column(f"k{i}")) for i, n in enumerate(names)}
    ids, place = np.unique(got.column("item_id").to_numpy(), return_inverse=True)
    turn = got.column("range").to_numpy().astype(np.int64) * max(1, len(ids)) + place
    out = []
    for i, s in enumerate(sources):
        rows = np.flatnonzero(got.column(f"a{i}").to_numpy()) if s.among is not None else None
        of = lambda a, rows=rows: a if rows is None else a.take(rows)
        mine = lambda keys, s=s, of=of: _pool(of(place), of(turn), [of(values[k]) for k in keys], of(values[s.block]) if s.block else None)
        out.append([mine(keys) for keys in ([tuple(s.keys)] + ([s.fallback] if s.fallback else []))])
    return ids, out


def _draws(heads: bytes, rows: list[bytes], attempt: int) -> np.ndarray:
    tail = b"%d" % attempt
    return np.frombuffer(b"".join([md5(heads + r + tail).digest()[:4] for r in rows]), ">u4").astype(np.int64)


def _worked(batch, ids: np.ndarray, found: list[list[Pool]], rules: list[tuple], each: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place of the item, source) of the negatives of whole terms; rows lie in the order of term and positive."""
    term, item = batch.column("term_id").to_numpy(), batch.column("item_id").to_numpy()
    n, width = len(term), max(1, len(ids))
    own = np.minimum(np.searchsorted(ids, item), width - 1)
    own = np.where(ids[own] == item, own, -1) if len(ids) else np.full(n, -1)
    local = np.cumsum(np.concatenate([[0], term[1:] != term[:-1]]))
    known = local[own >= 0] * width + own[own >= 0]  # in order
    known = np.append(known, np.iinfo(np.int64).max)
    rows = [b"%d|%d|" % p for p in zip(term.tolist(), item.tolist(), strict=True)]
    most_tries = max(r[4] for r in rules)
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # row, place, source x most_tries + try
    for i, (name, keys, other, most, tries) in enumerate(rules):
        col = lambda x, i=i: batch.column(f"{x}{i}").combine_chunks().dictionary_encode()
        of = found[i]
        at = np.flatnonzero(batch.column(f"w{i}").to_numpy())
        if not len(at):
            continue
        values = [col(f"k{j}_") for j in range(keys)]
        block = col("b") if f"b{i}" in batch.column_names else None
        at_pool = (of[0].find(values) if keys else np.full(n, 0 if len(of[0].order) else -1))[at]
        which = [(of[0], at, at_pool, block)]
        if other:
            lost = at_pool < 0
            which = [(of[0], at[~lost], at_pool[~lost], block), (of[1], at[lost], of[1].find([values[j] for j in other])[at[lost]], block)]
        for pool, r, p, b in which:
            r, p = r[p >= 0], p[p >= 0]
            if not len(r):
                continue
            start, size = pool.start[p], pool.size[p]
            skip, gap = size, np.zeros(len(r), np.int64)
            if b is not None:
                part = _coded(b, pool.blocks)[r]
                cell = p * len(pool.blocks) + part
                c = np.minimum(np.searchsorted(pool.cells, cell), len(pool.cells) - 1)
                has = (part >= 0) & (pool.cells[c] == cell)
                skip, gap = np.where(has, pool.cell_start[c], size), np.where(has, pool.cell_size[c], 0)
            free = size - gap
            live = np.flatnonzero(free > 0)
            have, count = np.full((len(r), most), -1, np.int64), np.zeros(len(r), np.int64)
            for t in range(tries):
                if not len(live):
                    break
                mine = r[live]
                x = _draws(b"%d|%s|" % (seed, name.encode()), [rows[k] for k in mine.tolist()] if len(mine) < n else rows, t) % free[live]
                x += np.where(x >= skip[live], gap[live], 0)
                neg = pool.order[start[live] + x].astype(np.int64)
                pair = local[mine] * width + neg
                ok = (neg != own[mine]) & (known[np.searchsorted(known, pair)] != pair)
                if t:
                    ok &= ~(have[live] == neg[:, None]).any(1)
                good = live[ok]
                have[good, count[good]] = neg[ok]
                count[good] += 1
                hits.append((mine[ok], neg[ok], np.full(len(good), i * most_tries + t, np.int64)))
                live = live[count[live] < most]
    if not hits:
        return (np.zeros(0, np.int64),) * 3
    row, neg, turn = (np.concatenate([h[k] for h in hits]) for k in range(3))
    group = np.cumsum(np.concatenate([[0], (term[1:] != term[:-1]) | (item[1:] != item[:-1])]))[row]  # the positive; a repeated one is the same
    pair = local[row] * width + neg
    order = np.lexsort((turn * n + group, pair))
    order = order[np.concatenate([[True], pair[order][1:] != pair[order][:-1]])]
    row, neg, turn, group = row[order], neg[order], turn[order], group[order]
    order = np.lexsort((neg, group * (most_tries * len(rules)) + turn))
    group = group[order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
    order = order[rank < each]
    return row[order], neg[order], turn[order] // most_tries


def chosen(positives: DataFrame, items: DataFrame, sources: list, each: int, seed: int) -> DataFrame:
    """(term_id, item_id, s), as ``negatives.negatives`` chooses them; s is the source's place. Rows without term or item take no part."""
    import pyarrow as pa

    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    ask: list[Column] = []
    for i, s in enumerate(sources):
        ask.append(F.coalesce(s.when, F.lit(False)).alias(f"w{i}") if s.when is not None else F.lit(True).alias(f"w{i}"))
        ask += [text(v).alias(f"k{j}_{i}") for j, v in enumerate(s.keys.values())] + ([text(s.own).alias(f"b{i}")] if s.block else [])
    kinds = dict(positives.dtypes)
    rows = positives.filter(F.col("term_id").isNotNull() & F.col("item_id").isNotNull()).select(F.col("term_id").cast("bigint").alias("term_id"), F.col("item_id").cast("bigint").alias("item_id"), *ask)
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("term_id").orderBy("item_id")))  # whole terms in one task, in order
    rules = [(s.name, len(s.keys), [list(s.keys).index(k) for k in s.fallback], s.most, s.tries) for s in sources]
    held = positives.sparkSession.sparkContext.broadcast(pools(items, sources))

    def run(batches: Iterator) -> Iterator:
        ids, found = held.value
        kept: list = []

        def done(table):
            row, neg, s = _worked(table, ids, found, rules, each, seed)
            return pa.RecordBatch.from_arrays([pa.array(table.column("term_id").to_numpy()[row]), pa.array(ids[neg]), pa.array(s, pa.int32())], names=["term_id", "item_id", "s"])

        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) < ROWS:
                continue
            starts = np.flatnonzero(batch.column(batch.schema.get_field_index("_n")).to_numpy() == 1)
            if not len(starts):
                continue
            cut = int(starts[-1])
            whole = pa.Table.from_batches([*kept[:-1], batch.slice(0, cut)])
            kept = [batch.slice(cut)]
            if whole.num_rows:
                yield done(whole)
        if kept and (whole := pa.Table.from_batches(kept)).num_rows:
            yield done(whole)

    got = rows.mapInArrow(run, "term_id bigint, item_id bigint, s int")
    return got.select(F.col("term_id").cast(kinds["term_id"]).alias("term_id"), F.col("item_id").cast(dict(items.dtypes)["item_id"]).alias("item_id"), "s")
