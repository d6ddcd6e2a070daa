"""Quality: nearest-neighbour voting in a latent-semantic space.

A text becomes three blocks of hashed terms: its words, the shapes of its tokens, and bands of a few counts over the
whole text. A truncated singular value decomposition of a bounded labelled sample gives the latent space. The labelled vectors are
sent to every executor (their number is bounded by SAMPLE); each batch of documents is multiplied with all of them, and the nearest ones
vote with their labels, weighted by similarity.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from quarry.llm.common import sliced

from quarry.llm.labelled import labelled_sample, score_rows
from quarry.llm.toxicity import STRIP

#: At most so many labelled rows are learned from, by label; they are also the neighbours that vote.
SAMPLE = {0: 2500, 1: 3500}
WORDS, SHAPES, BANDS = 1 << 14, 1 << 11, 1 << 10
SPACE = WORDS + SHAPES + BANDS
SHARE = (0.35, 1.0, 1.0)
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 6.0
BLOCK = 256
PIECE = 20_000
THRESHOLD = 0.7
CACHE = 80_000


def _hash(text: str, space: int) -> int:
    return xxhash.xxh64_intdigest(text.encode()) % space


def shape(token: str) -> str:
    """Kinds of characters, runs of a kind as one: ``Word!!`` -> ``Aa!``."""
    kind = lambda c: "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
    return "".join(k for k, _ in groupby(map(kind, token)))


class Terms:
    """(ids, weights) of a text: three blocks, each of unit length times its share."""

    def __init__(self):
        self.cache: dict[str, tuple[int, int, int]] = {}

    def _of(self, token: str) -> tuple[int, int, int]:
        """Term of the word, term of the shape, number of letters."""
        core = token.strip(STRIP).lower()
        return (_hash(core, WORDS) if core else -1), WORDS + _hash(shape(token), SHAPES), sum(map(str.isalpha, token))

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        count = Counter(text.split())
        n = sum(count.values())
        if not n:
            return np.zeros(0, np.int64), np.zeros(0)
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache, pairs = self.cache, []
        for t in count:
            if (pair := cache.get(t)) is None:
                pair = cache[t] = self._of(t)
            pairs.append(pair)
        times = np.fromiter(count.values(), np.float64, len(count))
        pairs = np.array(pairs, np.int64)
        parts = []
        for ids, share in ((pairs[:, 0], SHARE[0]), (pairs[:, 1], SHARE[1])):
            has = ids >= 0
            own, back = np.unique(ids[has], return_inverse=True)
            parts.append((own, np.log1p(np.bincount(back, times[has], len(own))), share))
        lines = [x for x in text.split("\n") if x.strip()]
        ratios = {
            "distinct": len(count) / n, "most": times.max() / n, "letters": float(pairs[:, 2] @ times) / len(text),
            "upper": sum(t.isupper() for t in count) / len(count), "lines": len(set(lines)) / max(1, len(lines)), "length": min(1.0, len(text) / n / 20),
        }
        bands = [f"{k}{int(r * 12)}" for k, r in ratios.items()] + [f"{k}~{int(r * 12 + 0.5)}" for k, r in ratios.items()]
        own, back = np.unique([WORDS + SHAPES + _hash(b, BANDS) for b in bands], return_inverse=True)
        parts.append((own, np.bincount(back).astype(float), SHARE[2]))
        ids = np.concatenate([p[0] for p in parts])
        return ids, np.concatenate([p[1] * (p[2] / (np.linalg.norm(p[1]) or 1.0)) for p in parts])


@dataclass
class Voters:
    """The latent space, the labelled vectors and their labels."""

    basis: np.ndarray
    vectors: np.ndarray
    label: np.ndarray
    prior: float

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "terms"}

    def latent(self, texts: list[str | None]) -> np.ndarray:
        if "terms" not in self.__dict__:
            self.__dict__["terms"] = Terms()
        out = np.zeros((len(texts), self.basis.shape[1]), np.float32)
        for i, t in enumerate(texts):
            ids, weight = self.terms(t)
            if len(ids):
                out[i] = weight @ self.basis[ids]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def __call__(self, texts: list[str | None]) -> list[float]:
        scores: list[float] = []
        for k in range(0, len(texts), BLOCK):
            mine = self.latent(texts[k : k + BLOCK])
            near = mine @ self.vectors.T
            n = min(NEIGHBOURS, near.shape[1])
            if not n:
                scores += [self.prior] * len(mine)
                continue
            top = np.argpartition(-near, n - 1, axis=1)[:, :n]
            vote = np.maximum(np.take_along_axis(near, top, 1), 0.0).astype(np.float64) ** SHARPNESS
            total = vote.sum(1)
            yes = (vote * self.label[top]).sum(1)
            last = np.take_along_axis(near, top, 1).min(1)
            for i in np.flatnonzero((near >= last[:, None]).sum(1) > n):  # ties at the last place all vote
                tied = np.flatnonzero(near[i] >= last[i])
                vote = np.maximum(near[i, tied], 0.0).astype(np.float64) ** SHARPNESS
                total[i], yes[i] = vote.sum(), vote @ self.label[tied]
            scores += np.where(total > 0, yes / np.where(total > 0, total, 1), self.prior).clip(0, 1).tolist()
        return scores


def fit_voters(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rank: int = RANK, seed: int = 5) -> Voters:
    """Randomised decomposition with two power steps; terms weigh by their rarity in the sample."""
    m, y = len(rows), np.asarray(y, np.float64)
    prior = float(y.mean()) if m else 0.5
    if not m:
        return Voters(np.zeros((SPACE, 1), np.float32), np.zeros((0, 1), np.float32), y, prior)
    size = np.array([len(r[0]) for r in rows])
    ids, seg = np.concatenate([r[0] for r in rows]).astype(np.int32), np.repeat(np.arange(m, dtype=np.int32), size)
    rarity = np.log((1 + m) / (1 + np.bincount(ids, minlength=SPACE))) + 1
    value = (np.concatenate([r[1] for r in rows]) * rarity[ids]).astype(np.float32)
    by = np.argsort(ids, kind="stable")

    def spread(index: np.ndarray, other: np.ndarray, val: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
        """Sums of val x dense[other] by index, which is sorted; in pieces of bounded size."""
        out = np.zeros((n, dense.shape[1]))
        for k in range(0, len(index), PIECE):
            i, part = index[k : k + PIECE], val[k : k + PIECE, None] * dense[other[k : k + PIECE]]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            np.add.at(out, i[first], np.add.reduceat(part, first))
        return out

    forward = lambda dense: spread(seg, ids, value, dense, m)
    backward = lambda dense: spread(ids[by], seg[by], value[by], dense, SPACE)
    q = forward(np.random.default_rng(seed).normal(size=(SPACE, min(rank + 8, m))))
    for _ in range(2):
        q = forward(backward(np.linalg.qr(q)[0]))
    q = np.linalg.qr(q)[0]
    _, _, vt = np.linalg.svd(backward(q).T, full_matrices=False)
    basis = (vt[:rank].T * rarity[:, None]).astype(np.float32)
    voters = Voters(basis, np.zeros((0, basis.shape[1]), np.float32), y, prior)
    latent = np.stack([weight @ basis[i] if len(i) else np.zeros(basis.shape[1]) for i, weight in rows]).astype(np.float32)
    norm = np.linalg.norm(latent, axis=1, keepdims=True)
    voters.vectors = latent / np.where(norm > 0, norm, 1)
    return voters


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: dict[int, int] = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Voters:
    """Learn from at most ``sample`` labelled rows. Without any labelled row every text scores 0.5."""
    import pyarrow as pa

    def run(batches):
        terms = Terms()
        for batch in sliced(batches):
            rows = [terms(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32())), batch.column(1)], names=["ids", "weights", "y"]
            )

    got = labelled_sample(docs, labels, label_col, sample, 5, id_col, text_col).mapInArrow(run, "ids array<int>, weights array<float>, y int").toArrow()
    numbers = lambda c, kind: [x.values.to_numpy(zero_copy_only=False).astype(kind) for x in got.column(c).combine_chunks()] if len(got) else []
    rows, y = list(zip(numbers("ids", np.int32), numbers("weights", np.float32), strict=True)), got.column("y").to_numpy().copy()
    del got
    order = sorted(range(len(rows)), key=lambda i: (y[i], len(rows[i][0]), rows[i][0].sum(dtype=np.int64), rows[i][1].sum(dtype=np.float64)))  # the same space at any partitioning
    return fit_voters([rows[i] for i in order], y[order] if len(y) else y)


def score(docs: DataFrame, voters: Voters, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row, repeated rows too.

    A null or empty text has no vector and gets the share of good labels in the sample. Labelled vectors that are as near as the
    last of the NEIGHBOURS vote too. Whole texts are scored, however long. An empty table gives an empty result. Only the named columns are read, so other columns can have any names.
    """
    return score_rows(docs, voters, threshold, id_col, text_col)
