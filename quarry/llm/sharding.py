"""Sharding by minimax contiguous partition.

Documents with equal texts form one atomic group. Groups that exceed an even share stand first, one in a shard; the others
lie in the order of a 64-bit hash of their text. The smallest
feasible shard capacity over that order comes from a binary search whose check is greedy. The driver never sees the
groups themselves: it starts from 4096 ranges of the hash and opens, 12 bits at a time, only the ranges in which a cut can
fall for a capacity that is still possible. What it gathers is bounded by (open ranges) x 4096 at every level.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm.common import materialize

BITS = 12
SALTS = 512


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, _h): bytes of the text plus 1, its checksum, and the hash that orders the groups.

    A null text counts as an empty one: size 1, checksum 0.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_h"),
    )


class _Atoms:
    """Ranges of the hash in order: first key, summed size, and whether the range holds one group only."""

    def __init__(self, key, total, single, shift):
        self.key, self.total, self.single, self.shift = key, total, single, shift

    def opened(self, mask: np.ndarray, finer: "_Atoms") -> "_Atoms":
        parts = [np.concatenate([getattr(self, n)[~mask], getattr(finer, n)]) for n in ("key", "total", "single", "shift")]
        order = np.argsort(parts[0], kind="stable")
        return _Atoms(*(p[order] for p in parts))


def _fetch(rows: DataFrame, shift: int, within: tuple[int, list[int]] | None) -> _Atoms:
    if within:
        rows = rows.filter(F.shiftright("_h", within[0]).isin(within[1]))
    got = (
        rows.groupBy(F.shiftright("_h", shift).alias("b"))
        .agg(F.min("_h").alias("lo"), F.max("_h").alias("hi"), F.sum("size").alias("total"))
        .collect()  # bounded: at most 4096 ranges for each one that is open
    )
    got.sort(key=lambda r: r.lo)
    return _Atoms(
        np.array([r.lo for r in got], np.int64), np.array([r.total for r in got], np.int64),
        np.array([r.lo == r.hi for r in got], bool), np.full(len(got), shift, np.int64),
    )


def greedy_cuts(prefix: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Ends (as counts of atoms) of the shards when each takes all that fits; None if more than ``shards`` are needed."""
    ends, at, n = [], 0, len(prefix)
    for _ in range(shards):
        base = prefix[at - 1] if at else 0
        at = max(at, int(np.searchsorted(prefix, base + capacity, side="right")))
        ends.append(at)
        if at == n:
            return ends + [n] * (shards - len(ends))
    return None


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """Binary search of the least capacity for which the greedy check succeeds."""
    if not len(sizes):
        return 0
    prefix = np.cumsum(sizes)
    lo, hi = max(int(sizes.max()), -(-int(prefix[-1]) // shards)), int(prefix[-1])
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy_cuts(prefix, mid, shards) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def minimax_ends(sizes: np.ndarray, shards: int) -> list[int]:
    """Ends of the shards at the smallest capacity."""
    if not len(sizes):
        return [0] * shards
    return greedy_cuts(np.cumsum(sizes), smallest_capacity(sizes, shards), shards)


def oversized(sizes: np.ndarray, shards: int, total: int) -> list[int]:
    """Places of the groups that alone exceed an even share of what is left without them; each gets a shard of its own."""
    out: list[int] = []
    left = total
    for i in np.argsort(-sizes, kind="stable").tolist():
        if len(out) == shards - 1 or int(sizes[i]) * (shards - len(out)) <= left:
            break
        out.append(i)
        left -= int(sizes[i])
    return out


def _needed(atoms: _Atoms, shards: int) -> np.ndarray:
    """Which ranges must be opened: those in which a cut can fall, and those as large as a part of a shard.

    Ranges as large as a part of a shard come first, so that oversized groups stand alone before cuts are looked for.
    A cut lies between where greedy cuts fall that never split a range, at the least conceivable capacity, and where those
    fall that split ranges anywhere, at the capacity found so far.
    """
    if not len(atoms.total):
        return np.zeros(0, bool)
    total, prefix = int(atoms.total.sum()), np.cumsum(atoms.total)
    start = prefix - atoms.total
    low = max(-(-total // shards), int(atoms.total[atoms.single].max(initial=1)))
    high = smallest_capacity(atoms.total, shards)
    large = (atoms.total * 4 * shards > total) & ~atoms.single & (atoms.shift > 0)
    if large.any():
        return large
    alone = oversized(np.where(atoms.single, atoms.total, 0), shards, total)
    if alone:
        rest = np.setdiff1d(np.arange(len(atoms.total)), alone)
        mask = np.zeros(len(atoms.total), bool)
        mask[rest] = _needed(_Atoms(atoms.key[rest], atoms.total[rest], atoms.single[rest], atoms.shift[rest]), shards - len(alone))
        return mask
    mask = np.zeros(len(atoms.total), bool)
    least = most = 0
    for _ in range(1, shards):
        at = min(int(np.searchsorted(prefix, least + low, side="right")), len(prefix) - 1)
        least = int(start[at]) if least + low < total else total
        at = min(int(np.searchsorted(prefix, most + high, side="right")), len(prefix) - 1)
        most = total if most + high >= total else int(start[at]) if atoms.single[at] else most + high
        mask |= (prefix > least) & (start < most)
    for at in minimax_ends(atoms.total, shards)[:-1]:
        mask[max(0, at - 1) : at + 1] = True
    return mask & ~atoms.single & (atoms.shift > 0)


def shard_rule(rows: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """(hashes of oversized groups, first hashes of the later shards).

    Oversized groups stand first in the order and take shards 0, 1, ...; the other groups follow by hash.
    """
    atoms = _fetch(rows, 64 - BITS, None)
    while (mask := _needed(atoms, shards)).any():
        shift = int(atoms.shift[mask].max())
        mask &= atoms.shift == shift
        atoms = atoms.opened(mask, _fetch(rows, max(0, shift - BITS), (shift, [int(k) >> shift for k in atoms.key[mask]])))
    alone = oversized(atoms.total, shards, int(atoms.total.sum()))
    rest = np.setdiff1d(np.arange(len(atoms.total)), alone)
    keys, ends = atoms.key[rest], minimax_ends(atoms.total[rest], shards - len(alone))
    return [int(atoms.key[i]) for i in alone], [int(keys[e]) for e in ends[:-1] if e < len(keys)]


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every document into one of ``shards`` shards of near equal bytes; equal texts stay together.

    The order of the groups: those that exceed an even share of what the others leave come first, the largest first, one to a shard; the others
    follow by a 64-bit hash of their text, and the smallest feasible capacity cuts them.
    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (0, 1, ... in each shard) and grown_shard (null).
    Null and empty texts are one group of size 1 a row. Repeated rows all get slots of their own; an empty table gives
    an empty result. Only the named columns are read, so other columns can have any names.
    """
    rows = materialize(sized(docs, id_col, text_col), "shard")
    alone, starts = shard_rule(rows, shards)
    number = F.lit(len(alone))
    for s in starts:
        number = number + (F.col("_h") >= F.lit(s).cast("long")).cast("int")
    for i, s in enumerate(alone):
        number = F.when(F.col("_h") == F.lit(s).cast("long"), i).otherwise(number)
    dealt = rows.select("*", number.alias("shard"), F.pmod(F.xxhash64("doc_id", "_h"), F.lit(SALTS)).cast("int").alias("_salt"))
    counts = dealt.groupBy("shard", "_salt").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = W.partitionBy("shard", "_salt").orderBy("doc_id", "_h")
    return (
        dealt.join(F.broadcast(offsets), ["shard", "_salt"])  # bounded: shards x SALTS rows
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("_offset") + F.row_number().over(within) - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
