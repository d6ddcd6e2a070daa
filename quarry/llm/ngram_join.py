"""Exact self-join of documents on the Jaccard similarity of their word n-grams, by universe partition.

The hashed n-grams of a document fall into the segments of its size band. Two sets whose symmetric difference is at
most H must agree in some segment if one of them fills more than H segments, so equal segments are the candidates:

* Bands: sizes in [lo, 1.5 lo). A set also enters the next bands in which a partner can lie. A band has as many segments
  as its largest sets need.
* Index: each filled segment of each set, as one 64-bit signature. Empty segments are never indexed.
* Allocation: of its filled segments a set probes the H + 1 cheapest, where cost is the number of sets with the same
  signature. What a hot segment costs is only paid where no cheaper one is left. A set that fills fewer than H + 1 gets
  two from each of its segments: it enters them with all one-deletion neighbours, in a space of their own, which is complete for
  pairs of two such sets; and a last space joins those for which even this falls short.
* Copies: equal sets are one class from the start. Only classes are joined.
* Links: each candidate first links to one hub of its segment, then to a few more where segments are large, and only what
  lies in different components after that is compared pair by pair, so groups of near copies don't cost all pairs. Parity sketches bound the difference from below and
  drop pairs that can't link. The rest is verified on the n-grams themselves.

* Hot segments: a task that meets a signature more than SPLIT times spreads the rest over PARTS parts, so that no window holds a
  segment that a third of the rows share; what the parts know is merged by partial aggregation.

64-bit hashes stand for n-grams in the candidate search, where a collision adds candidates that verification removes, and in
the size of a set, where one would count two n-grams of one document as one (for 1000 n-grams a chance of 3 in 10^14). A class is
known by 128 bits of its hashes. Nodes of the graph are 63 of these bits; classes that clash in them (about n^2 / 2^64 of n
classes) are found and get numbers of their own, so that a node always is one class.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm.common import ARROW_ROWS, materialize, release, sliced
from quarry.llm.components import components

GROWTH = 1.5
SKETCH = 8
CACHE = 80_000
#: Sets of ids up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 250_000
#: Drawn hubs of a large segment in the first round after the star; MORE_HUBS times as many in each further round.
HUBS, MORE_HUBS = 16, 64
#: A signature that a task has met so often is split from then on, into so many parts; COUNTERS count signatures by their low bits.
SPLIT, PARTS, COUNTERS = 64, 1024, 1 << 18
#: Bits of a class that name its node.
NODE_BITS = 63
_MIX1, _MIX2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_33 = np.uint64(33)


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingles(text: str | None, n: int) -> set[bytes]:
    """The distinct n-grams; with fewer words the whole sequence as one; none without words."""
    w = words(text)
    if len(w) < n:
        return {b"\0".join(w)} if w else set()
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _33)) * _MIX1
    x = (x ^ (x >> _33)) * _MIX2
    return x ^ (x >> _33)


class Hasher:
    """Sorted distinct 64-bit hashes of a text's n-grams. The cache of words is emptied when full."""

    def __init__(self, n: int):
        self.n, self.cache = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        w, cache = words(text), self.cache
        if not w:
            return np.zeros(0, np.uint64)
        try:
            of = [cache[x] for x in w]
        except KeyError:
            if len(cache) > CACHE:
                cache.clear()
            for x in set(w):
                if x not in cache:
                    cache[x] = xxhash.xxh3_64_intdigest(x)
            of = [cache[x] for x in w]
        h = np.array(of, np.uint64)
        size = min(self.n, len(h))
        total = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            total = (total ^ h[k : len(h) - size + 1 + k]) * _MIX1
            total ^= total >> np.uint64(29)
        return np.unique(_mix(total))


def most_differing(size: int, num: int, den: int) -> int:
    """Largest symmetric difference of a set of this size and any linked set that is not smaller."""
    return (size + size * den // num) * (den - num) // (den + num)


@lru_cache
def bands(num: int, den: int) -> tuple[list[int], list[int]]:
    """Lower ends of the size bands, and segments of each."""
    lows, counts = [1], []
    while lows[-1] < 1 << 33:
        lows.append(max(lows[-1] + 1, int(lows[-1] * GROWTH)))
    for top in (x - 1 for x in lows[1:]):
        need = most_differing(top, num, den) + 1
        m = need
        while need > 1 and m - (empty := m * math.exp(-top / m)) - 2 * math.sqrt(empty) < need and m <= need + need // 4:
            m += max(1, m // 64)
        counts.append(m)
    return lows[:-1], counts


def schemes(size: int, num: int, den: int) -> list[tuple[int, int]]:
    """(band, segments) of each band that a set of this size enters; none if it only links with equal sets."""
    if most_differing(size, num, den) == 0:
        return []
    lows, counts = bands(num, den)
    first, last = bisect_right(lows, size) - 1, bisect_right(lows, size * den // num) - 1
    return [(b, counts[b]) for b in range(first, last + 1)]


def _salt(band: int, space: int) -> np.uint64:
    return np.uint64((4 * band + space) * int(_STEP) & (1 << 64) - 1)


def signatures(h: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, spare) of each index entry; spare: filled segments of the scheme that need not be probed."""
    sigs, spares = [], []
    mixed = _mix(h ^ _STEP)
    for band, m in schemes(len(h), num, den):
        segment = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # rises with the hash
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        total = np.add.reduceat(mixed, first)
        place = segment[first] * _MIX2 + _salt(band, 1)
        need = most_differing(len(h), num, den) + 1
        sigs.append(_mix(total ^ place))
        spares.append(np.full(len(first), max(0, len(first) - need), np.int32))
        if len(first) < need:
            size = np.diff(np.r_[first, len(h)])
            place = segment[first] * _MIX2 + _salt(band, 2)
            near = np.r_[_mix(total ^ place), _mix((np.repeat(total, size) - mixed) ^ np.repeat(place, size))]
            if 2 * len(first) < need:
                near = np.r_[near, _mix(np.array([_salt(band, 3)]))]
            near = np.unique(near)
            sigs.append(near)
            spares.append(np.zeros(len(near), np.int32))
    if not sigs:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(sigs).view(np.int64), np.concatenate(spares)


def sketch(h: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes in each of 64 x SKETCH cells; two sketches differ in no more cells than the sets do in members."""
    cells = 64 * SKETCH
    odd = (np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def wide_sketch(h: np.ndarray) -> bytes:
    """The same parities in a power of two of cells, at least twice the size of the set."""
    cells = 64 << max(0, (len(h) - 1) // 32).bit_length()
    return np.packbits((np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)).tobytes()


def wide_apart(a: bytes, b: bytes) -> int:
    """Cells in which two wide sketches differ; the longer one is folded, which gives the parities in fewer cells."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _key(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def _node(key: bytes, moved: dict[bytes, int]) -> int:
    """The number of a class: not negative, but for those in ``moved``."""
    return moved[key] if key in moved else int.from_bytes(key[:8], "big") >> (64 - NODE_BITS)


def _classes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, th, key, node, size, wide, s0...): the set of every row. key: 128 bits of the set, null for an empty one."""
    import pyarrow as pa

    def run(batches):
        hasher = Hasher(n)
        for batch in sliced(batches):
            keys, sizes, wide, sketches = [], [], [], []
            for t in batch.column(2).to_pylist():
                h = hasher(t)
                keys.append(_key(h) if len(h) else None)
                sizes.append(len(h))
                wide.append(wide_sketch(h) if len(h) else None)
                sketches.append(sketch(h))
            cells = np.array(sketches, np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array([_node(k, {}) if k else None for k in keys], pa.int64()), pa.array(sizes, pa.int64()), pa.array(wide, pa.binary()), *(pa.array(cells[:, k]) for k in range(SKETCH))],
                names=["doc_id", "th", "key", "node", "size", "wide", *(f"s{k}" for k in range(SKETCH))],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, th long, key binary, node long, size long, wide binary, " + ", ".join(f"s{k} long" for k in range(SKETCH)))


def _numbered(info: DataFrame) -> tuple[DataFrame, dict[bytes, int]]:
    """``info`` with a node of its own for each class, and the classes whose node isn't that of their bits."""
    clash = info.groupBy("node").agg(F.count("*").alias("_n")).filter("_n > 1").select("node")
    keys = sorted(bytes(r.key) for r in info.join(clash, "node", "left_semi").select("key").collect())  # bounded: clashes of 63 bits
    moved = {k: -1 - i for i, k in enumerate(keys)}
    if moved:
        own = info.sparkSession.createDataFrame([(bytearray(k), v) for k, v in moved.items()], "key binary, _own long")
        info = info.join(F.broadcast(own), "key", "left").withColumn("node", F.coalesce("_own", "node")).drop("_own")
    return info, moved


def _index(docs: DataFrame, n: int, num: int, den: int, moved: dict[bytes, int]) -> DataFrame:
    """(sig, node, spare, part) of every row's set. Copies that one task meets are entered once, before any shuffle.

    part is 0 until the task has met a signature in SPLIT different sets, then one of PARTS; so part 0 of a split segment always holds
    several classes.
    """
    import pyarrow as pa

    def run(batches):
        hasher, seen, met = Hasher(n), set(), np.zeros(COUNTERS, np.int32)
        for batch in sliced(batches):
            sigs, nodes, spares, parts = [], [], [], []
            for t in batch.column(0).to_pylist():
                h = hasher(t)
                node = _node(_key(h), moved)
                if node in seen:
                    continue
                if len(seen) > CACHE:
                    seen.clear()
                    met[:] = 0
                seen.add(node)
                sig, spare = signatures(h, num, den)
                place = sig & (COUNTERS - 1)
                hot = met[place] >= SPLIT
                met[place] += 1
                sigs.append(sig)
                nodes.append(np.full(len(sig), node, np.int64))
                spares.append(spare)
                parts.append(np.where(hot, 1 + node % PARTS, 0).astype(np.int32))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sigs, nodes, spares, parts)], names=["sig", "node", "spare", "part"])

    return docs.select("text").mapInArrow(run, "sig long, node long, spare int, part int")


def _few(df: DataFrame) -> DataFrame:
    """Broadcast a table that is already written if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _shared(index: DataFrame) -> DataFrame:
    """(sig, node, spare, hub, cost) of the segments that two classes share; hub is the least node, cost the number of entries."""
    same = W.partitionBy("sig", "part")
    rows = (
        index.select("*", F.min("node").over(same).alias("hub"), F.max("node").over(same).alias("_hi"), F.count("*").over(same).alias("cost"))
        .filter("hub <> _hi or part > 0")
    )
    rows = materialize(rows.drop("_hi").dropDuplicates(["sig", "part", "node"]), "shared")
    split = materialize(rows.filter("part > 0").select("sig").distinct(), "split")
    if split.isEmpty():
        out = rows.drop("part")
        out.written = rows.written
        return out
    parts = rows.join(_few(split), "sig", "left_semi").groupBy("sig", "part").agg(F.min("hub").alias("hub"), F.min("cost").alias("cost"))
    whole = materialize(parts.groupBy("sig").agg(F.min("hub").alias("_hub"), F.sum("cost").alias("_cost")), "whole")
    joined = rows.join(_few(whole), "sig", "left")
    return materialize(joined.select("sig", "node", "spare", F.coalesce("_hub", "hub").alias("hub"), F.coalesce("_cost", "cost").alias("cost")).dropDuplicates(["sig", "node"]), "shared")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose n-gram sets link, written: what wide sketches leave possible is compared on the n-grams themselves.

    The hub's side is joined last, so its text is sent once to a task and not once a pair, and its n-grams are made once for a run of
    pairs; Spark splits a hub with very many pairs, as the join is skewed.
    """
    import pyarrow as pa

    def prune(batches):
        for batch in sliced(batches, 10 * ARROW_ROWS):
            y, n_, x, m = (batch.column(k).to_pylist() for k in range(2, 6))
            keep = [wide_apart(a, b) * (den + num) <= (i + j) * (den - num) for a, b, i, j in zip(x, y, m, n_, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c, w, s: reps.select(F.col("node").alias(c), F.col("wide").alias(w), F.col("size").alias(s))
    wide = pairs.join(of("b", "_y", "_n"), "b").join(of("a", "_x", "_m"), "a").select("a", "b", "_y", "_n", "_x", "_m")
    pairs = materialize(wide.mapInArrow(prune, "a long, b long").distinct(), "pruned")
    reps = reps.select("node", "doc_id", "th")
    wanted = materialize(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct().join(reps, "node"), "wanted")
    ids = _few(wanted).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "node")
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("node", "text").dropDuplicates(["node"])
    texts = materialize(texts, "texts")

    def run(batches):
        hub, x = None, set()
        for batch in sliced(batches):
            keep = []
            for a, t, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if a != hub:
                    hub, x = a, shingles(s.as_py(), n)
                y = shingles(t, n)
                common = len(x & y)
                keep.append(den * common >= num * (len(x) + len(y) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c, t: texts.select(F.col("node").alias(c), F.col("text").alias(t))
    joined = pairs.join(side("b", "_t"), "b").join(side("a", "_s"), "a").select("a", "b", "_t", "_s")
    out = materialize(joined.mapInArrow(run, "a long, b long"), "links")
    release(pairs, wanted, texts)
    return out


def _possible(num: int, den: int):
    """A condition on two rows x_, y_: sizes and parity sketches leave the similarity possible. It never excludes a link."""
    x, y = F.col("x_size"), F.col("y_size")
    apart = sum((F.bit_count(F.col(f"x_s{k}").bitwiseXOR(F.col(f"y_s{k}"))) for k in range(SKETCH)), F.lit(0))
    return (F.least(x, y) * den >= F.greatest(x, y) * num) & (apart * (den + num) <= (x + y) * (den - num))


def _open(entries: DataFrame, labels: DataFrame, known: DataFrame) -> DataFrame:
    """Entries of segments that hold several components, with label, sizes and sketches, the number of members of the segment, and
    whether the entry is apart from the component of the segment's first hub."""
    label = labels.select("node", "label")
    rows = (
        entries.join(label, "node", "left")
        .join(label.select(F.col("node").alias("hub"), F.col("label").alias("_hl")), "hub", "left")
        .select("sig", "node", "probe", F.coalesce("label", "node").alias("label"), F.coalesce("_hl", "hub").alias("_hl"))
        .select("sig", "node", "probe", "label", (F.col("label") != F.col("_hl")).alias("apart"))
    )
    rows = materialize(rows, "labelled")
    several = rows.groupBy("sig").agg(F.count("*").alias("members"), F.max("apart").alias("_open")).filter("_open").drop("_open")  # partial counts: a hot segment is one row a task
    several = materialize(several, "several")
    out = materialize(rows.join(_few(several), "sig").join(known, "node"), "open")
    release(rows, several)
    return out


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in ("sig", "cell") else prefix + c) for c in df.columns])


def _cells(df: DataFrame, num: int, den: int, near: bool) -> DataFrame:
    """A size cell as part of the join key: sets that link lie in the same cell or in neighbouring ones; ``near``: a row for each."""
    own = F.floor(F.log(F.col("size")) / (1.01 * math.log(max(den / num, 1.0001)))).cast("int")
    return df.withColumn("cell", F.explode(F.array(own - 1, own, own + 1)) if near else own)


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, th and keep.

    ``th`` is a hash of the text; ``keep`` is true for the first row of each component, by doc_id and th, and for every row that
    links with nothing.

    Two rows link when den * (common n-grams) >= num * (n-grams of either). component_id is the smallest doc_id that
    links lead to, itself included. A row with fewer than n words has one n-gram, the whole sequence; a null or
    empty text, or one of white space, has none and links with nothing. Repeated rows are copies of each other. A null id stays
    a row; it never becomes a component_id if the component has another. An empty table gives an empty result. Only
    the named columns are read, so other columns can have any names.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(_classes(docs, n), "classes")
    cells = [f"s{k}" for k in range(SKETCH)]
    info = materialize(
        rows.filter("size > 0").groupBy("key", "node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("rep"), F.first("size").alias("size"), F.first("wide").alias("wide"), *[F.first(c).alias(c) for c in cells]),
        "info",
    )
    info, moved = _numbered(info)
    reps, known = info.select("node", "size", "wide", "rep.doc_id", "rep.th"), info.select("node", "size", *cells)

    # index entries of segments that two classes share
    shared = _shared(_index(docs, n, num, den, moved))

    # first each entry against the hub of its segment
    star = shared.filter("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    plausible = _possible(num, den)
    star = star.join(_named(known, "x_").withColumnRenamed("x_node", "a"), "a").join(_named(known, "y_").withColumnRenamed("y_node", "b"), "b")
    star = materialize(star.filter(plausible).select("a", "b"), "star")
    links = _verified(star, reps, docs, n, num, den)
    labels, spent = components(links), [star, links]

    # then pairs of different components only: in large segments first against a few drawn hubs, at last against everything
    by_cost = W.partitionBy("node", "spare").orderBy(F.col("cost").desc(), "sig")
    entries = materialize(shared.withColumn("probe", F.row_number().over(by_cost) > F.col("spare")).select("sig", "node", "probe", "hub"), "entries")
    done, hubs = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), HUBS
    while True:
        open_ = _open(entries, labels, known)
        largest = open_.agg(F.max("members")).first()[0] or 0
        last = largest <= 4 * hubs
        if last:
            sides = [(open_.filter("probe and apart"), open_), (open_.filter("probe and not apart"), open_.filter("apart"))]
        else:
            drawn = W.partitionBy("sig").orderBy(F.xxhash64("node", F.lit(hubs)), "node")
            few = open_.withColumn("_r", F.row_number().over(drawn)).filter(F.col("_r") <= hubs).drop("_r")
            sides = [(_cells(few, num, den, True), _cells(open_, num, den, False))]  # the few hubs are repeated, not the members
        pairs = None
        for mine, other in sides:
            got = _named(mine, "x_").join(_named(other, "y_"), ["sig"] if last else ["sig", "cell"]).filter((F.col("x_label") != F.col("y_label")) & plausible)
            got = got.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
            pairs = got if pairs is None else pairs.unionAll(got)
        pairs = materialize(pairs.distinct().join(done, ["a", "b"], "left_anti"), "pairs")
        more = _verified(pairs, reps, docs, n, num, den)
        release(open_)
        spent += [pairs, more]
        if not more.isEmpty():
            links, old = links.unionAll(more), labels
            labels = components(links)
            release(old)
        if last:
            break
        done, hubs = done.unionAll(pairs), MORE_HUBS * hubs

    # back to the rows
    release(shared, entries, *spent)
    classes = info.select("key", "node", "rep").join(labels, "node", "left").select("key", "rep", F.coalesce("label", "node").alias("label"))
    first = materialize(classes.groupBy("label").agg(F.min("rep").alias("first")), "first")  # written, so that Spark can split a hot label below
    of = classes.join(first, "label").select("key", "first")
    found = rows.select("doc_id", "th", "key", "size").join(of, "key", "left")
    keep = F.col("first").isNull() | (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.th") == F.col("th")))
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"), "th", keep.alias("keep"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row left of each component; all columns stay. Of rows with equal id and text one is left."""
    found = materialize(jaccard_components(docs, n, num, den, id_col, text_col).select("doc_id", "th", "keep", "n_shingles"), "found")
    gone = found.filter("not keep").select(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th")).distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    left = docs.join(gone, docs[id_col].eqNullSafe(F.col("_gone_id")) & (F.xxhash64(docs[text_col]) == F.col("_gone_th")), "left_anti")
    again = found.filter("keep and n_shingles > 0").groupBy("doc_id", "th").count().filter("count > 1")
    return left if again.isEmpty() else left.dropDuplicates([id_col, text_col])
