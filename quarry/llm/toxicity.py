"""Toxicity: a factorization machine over hashed terms.

Terms are a text's distinct words and the beginnings of its words, hashed. The machine adds a weight for each term and, for each pair of terms, the product of
their factor vectors, so that it learns that two harmless terms are toxic together. Training runs on a bounded sample
of labelled rows; the model's arrays have at most SPACE rows, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import held_out, sliced
from quarry.llm.labelled import labelled_sample, score_rows

#: At most so many labelled rows are learned from, by label.
SAMPLE = {0: 5000, 1: 2500}
SPACE = 1 << 20
FACTORS = 8
THRESHOLD = 0.3
#: Factors stay if they bring the loss of the rows held back below so much of what the weights alone reach.
GAIN = 0.95
STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…–—¡¿·"
CACHE = 80_000


class Terms:
    """Hashed terms of texts. The cache of words is emptied when full."""

    def __init__(self):
        self.cache: dict[str, tuple[int, ...]] = {}

    def _of(self, token: str) -> tuple[int, ...]:
        core = token.strip(STRIP)
        names = [f"w{core}"] + [f"b{n}{core[:n]}" for n in (4, 5, 6) if len(core) >= n] if core else []
        return tuple(xxhash.xxh64_intdigest(n.encode()) % SPACE for n in names)

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = set((text or "").lower().split())
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache, out = self.cache, set()
        for t in tokens:
            if (ids := cache.get(t)) is None:
                ids = cache[t] = self._of(t)
            out.update(ids)
        return np.fromiter(out, np.int64, len(out))


@dataclass
class Machine:
    """place: hashed term -> row of the arrays, 0 for terms that were too rare to learn."""

    place: np.ndarray
    weight: np.ndarray
    factor: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def __call__(self, texts: list[str | None]) -> list[float]:
        if "terms" not in self.__dict__:
            self.__dict__["terms"] = Terms()
        return [self.score(self.terms(t)) for t in texts]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "terms"}

    def score(self, ids: np.ndarray) -> float:
        z = self.scale * self.sum(ids) + self.shift
        return float(_sigmoid(z))

    def sum(self, ids: np.ndarray) -> float:
        at = self.place[ids]
        at = at[at > 0]
        v = self.factor[at]
        total = v.sum(0)
        return self.bias + float(self.weight[at].sum()) + 0.5 * float((total * total).sum() - (v * v).sum())


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(_sigmoid(z), 1e-9, 1 - 1e-9)
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


class _Rows:
    """Rows of places as one array, and the sums of a machine over them."""

    def __init__(self, rows: list[np.ndarray]):
        self.n, self.ids = len(rows), np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32, copy=False)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(r) for r in rows])

    def linear(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.ids], self.n)

    def pairs(self, v: np.ndarray, used: np.ndarray) -> np.ndarray:
        on = used[self.ids]
        ids, row, out = self.ids[on], self.row[on], np.zeros(self.n)
        for x in v.T:
            out += np.bincount(row, x[ids], self.n) ** 2 - np.bincount(row, x[ids] ** 2, self.n)
        return 0.5 * out


class _Trainer:
    """Adagrad on the logistic loss. Weights are soft-thresholded, so that the many terms of a long text don't drown a toxic one;
    factors of the terms in ``used`` carry an L2 penalty."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, terms: int, seed: int):
        self.rows, self.y, self.rng = rows, y, np.random.default_rng(seed)
        self.w, self.gw = np.zeros(terms), np.full(terms, 1e-2)
        self.v, self.gv, self.used = None, None, np.zeros(terms, bool)
        ones = y.mean() if len(y) else 0.5
        self.bias = float(np.log((ones + 1e-3) / (1 - ones + 1e-3)))

    def pair(self, v: np.ndarray) -> None:
        """Train factors too, from ``v`` on."""
        self.v, self.gv, self.used = v, np.full(v.shape, 1e-2), (v != 0).any(1)
        self.gw[self.used] = 1e-2

    def epoch(self, rate: float, sparse: float, batch: int = 64, ridge: float = 1e-3) -> None:
        order, paired = self.rng.permutation(len(self.rows)), self.used.any()
        for k in range(0, len(order), batch):
            part = _Rows([self.rows[i] for i in order[k : k + batch]])
            z = self.bias + part.linear(self.w)
            if paired:
                on = self.used[part.ids]
                ids, row = part.ids[on], part.row[on]
                own = self.v[ids]
                total = np.zeros((part.n, FACTORS))
                np.add.at(total, row, own)
                z += 0.5 * ((total**2).sum(1) - np.bincount(row, (own**2).sum(1), part.n))
            g = _sigmoid(z) - self.y[order[k : k + batch]]
            self.bias -= 0.02 * float(g.mean())
            term, back = np.unique(part.ids, return_inverse=True)
            d = np.bincount(back, g[part.row], len(term))
            self.gw[term] += d**2
            step = rate / np.sqrt(self.gw[term])
            moved = self.w[term] - step * d
            self.w[term] = np.sign(moved) * np.maximum(np.abs(moved) - sparse * step, 0)
            if paired and len(ids):
                term, back = np.unique(ids, return_inverse=True)
                d = ridge * self.v[term]
                np.add.at(d, back, g[row][:, None] * (total[row] - own))
                self.gv[term] += d**2
                self.v[term] -= rate / np.sqrt(self.gv[term]) * d

    def run(self, epochs: int, rate: float, sparse: float) -> None:
        for e in range(epochs):
            self.epoch(rate * (1 - e / epochs), sparse)


def interactions(rows: list[np.ndarray], residual: np.ndarray, variance: np.ndarray, among: np.ndarray, block: int = 256, least: int = 5):
    """(a, b, z) of the pairs of terms whose rows are labelled one more, or less, often than the weights say.

    z is the summed residual of the rows that hold both terms over its standard deviation, less what the largest of as many
    pairs of noise would reach. Blocks of terms are multiplied with each other, so no pair is left out and memory is bounded.
    """
    part, m = _Rows([r[np.isin(r, among, assume_unique=True)] for r in rows]), len(among)
    at = np.zeros(int(among.max(initial=0)) + 1, np.int32)
    at[among] = np.arange(m)
    ids, row = at[part.ids], part.row
    by = np.argsort(ids, kind="stable")
    ids, row = ids[by], row[by]
    edge = np.searchsorted(ids, np.arange(0, m + block, block))

    def dense(k: int) -> np.ndarray:
        x = np.zeros((part.n, min(block, m - k * block)), np.float32)
        x[row[edge[k] : edge[k + 1]], ids[edge[k] : edge[k + 1]] - k * block] = 1
        return x

    noise = np.sqrt(2 * np.log(max(m, 2) ** 2 / 2))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i in range(-(-m // block)):
        x = dense(i)
        xr, xv = (x * residual[:, None].astype(np.float32)).T, (x * variance[:, None].astype(np.float32)).T
        for j in range(i, -(-m // block)):
            y = x if i == j else dense(j)
            z = (xr @ y) / np.sqrt(xv @ y + 0.25)
            a, b = np.nonzero(np.abs(z) > noise)
            a, b = (k[a + i * block < b + j * block] for k in (a, b))
            enough = np.array([float(x[:, s] @ y[:, t]) >= least for s, t in zip(a, b, strict=True)], bool)
            a, b = a[enough], b[enough]
            over = z[a, b]
            found.append((among[a + i * block], among[b + j * block], np.sign(over) * (np.abs(over) - noise)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def spectral(a: np.ndarray, b: np.ndarray, value: np.ndarray, terms: int, rng: np.random.Generator, rounds: int = 60) -> np.ndarray:
    """Factors whose products come nearest to ``value`` at the pairs (a, b): leading eigenvectors of that symmetric matrix."""
    used, at = np.unique(np.r_[a, b], return_inverse=True)
    a, b, m = at[: len(a)], at[len(a) :], len(used)
    times = lambda q: np.stack([np.bincount(a, value * c[b], m) + np.bincount(b, value * c[a], m) for c in q.T], 1)
    shift = np.max(np.bincount(a, np.abs(value), m) + np.bincount(b, np.abs(value), m))
    q = rng.normal(size=(m, min(FACTORS, m)))
    for _ in range(rounds):
        q = np.linalg.qr(times(q) + shift * q)[0]
    size, turn = np.linalg.eigh(q.T @ times(q))
    out = np.zeros((terms, FACTORS))
    out[used, : q.shape[1]] = (q @ turn) * np.sqrt(np.maximum(size, 0))
    return out


def fit_machine(terms: list[np.ndarray], y: np.ndarray, epochs: int = 10, rate: float = 0.15, sparse: float = 0.15, factor_epochs: int = 30, seed: int = 11, base: float | None = None) -> Machine:
    """Weights first, then the pairs that they leave unexplained, then both together.

    A second, sparser set of weights gives residuals; pairs of its terms whose residuals stand out of the noise give the start of the factors
    (random small factors would drown in the thousands of pairs of a long text). Both parts are then trained together. One row
    in five is held back: the factors of the epoch with the least loss there are kept, none if the weights alone do about as well
    (GAIN; ``factor_epochs`` 0: weights alone), and the scores are calibrated on them to ``base``, the share of ones among all labels.
    Every term in 3 rows or more is learned.
    """
    y = np.asarray(y, np.float64)
    count = np.zeros(SPACE, np.int32)
    for t in terms:
        count[t] += 1  # a row's terms are distinct
    kept = np.flatnonzero(count >= 3)
    place = np.zeros(SPACE, np.int32)
    place[kept] = np.arange(1, len(kept) + 1)
    n = len(kept) + 1
    rows = [(lambda a: a[a > 0])(place[t]) for t in terms]
    held = [i for i in range(len(rows)) if i % 5 == 4] if len(rows) >= 50 else []
    fit = np.array([i for i in range(len(rows)) if not held or i % 5 != 4], int)
    mine, want = [rows[i] for i in fit], y[fit]
    model = _Trainer(mine, want, n, seed)
    learnable = len(y) > 0 and 0 < want.mean() < 1
    if learnable:
        model.run(epochs, rate, sparse)
    if learnable and held and factor_epochs:
        out, best = _Rows([rows[i] for i in held]), (model.w.copy(), None, model.bias)
        least = GAIN * _loss(model.bias + out.linear(model.w), y[held])
        screen = _Trainer(mine, want, n, seed)
        screen.run(2 * epochs, 2 / 3 * rate, 2 * sparse)
        all_ = _Rows(mine)
        p = _sigmoid(screen.bias + all_.linear(screen.w))
        often = np.bincount(all_.ids, minlength=n) >= 8
        among = np.flatnonzero((screen.w != 0) & often)
        del screen
        a, b, z = interactions(mine, want - p, np.maximum(p * (1 - p), (want - p) ** 2 / 3), among)
        if len(a):
            model.pair(spectral(a, b, z, n, model.rng))
            linear, pairs = model.bias + all_.linear(model.w), all_.pairs(model.v, model.used)
            model.v *= np.sqrt(min(np.geomspace(1e-3, 10, 25), key=lambda c: _loss(linear + c * pairs, want)))
            for e in range(factor_epochs):
                model.epoch(rate * (1 - e / factor_epochs), sparse)
                if (now := _loss(model.bias + out.linear(model.w) + out.pairs(model.v, model.used), y[held])) < least:
                    least, best = now, (model.w.copy(), model.v.copy(), model.bias)
        model.w, model.v, model.bias = best
    factor = np.zeros((n, FACTORS), np.float32) if model.v is None else model.v.astype(np.float32)
    machine = Machine(place, model.w.astype(np.float32), factor, model.bias)
    if held and 0 < y[held].mean() < 1:
        share = base if base and 0 < base < 1 else float(y[held].mean())
        machine.scale, machine.shift = calibrated(np.array([machine.sum(terms[i]) for i in held]), y[held], share)
    return machine


def calibrated(z: np.ndarray, y: np.ndarray, base: float, ridge: float = 0.02) -> tuple[float, float]:
    """Scale and shift of a logistic fit to sums of rows that took no part in training, weighted to the share of ones among all labels."""
    x = np.stack([z, np.ones(len(z))], 1)
    weight = np.where(y == 1, base / y.mean(), (1 - base) / (1 - y.mean()))
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * len(z) * 0.01 * (w - [1.0, 0.0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * len(z) * 0.01 * np.eye(2)
        w -= np.linalg.solve(h, g)
    return float(max(w[0], 0.1)), float(w[1])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: dict[int, int] = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Learn from at most ``sample`` labelled rows. Without any labelled row the machine scores 0.5 for every text."""
    import pyarrow as pa

    def run(batches):
        terms = Terms()
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array([terms(t).tolist() for t in batch.column(0).to_pylist()], pa.list_(pa.int32())), batch.column(1)], names=["terms", "y"])

    got = labelled_sample(docs, labels, label_col, sample, 3, id_col, text_col).mapInArrow(run, "terms array<int>, y int").toArrow()
    lists = got.column("terms").combine_chunks()
    terms = [np.sort(x.values.to_numpy(zero_copy_only=False)) for x in lists] if len(lists) else []
    y = got.column("y").to_numpy().copy()
    del got, lists
    order = sorted(range(len(terms)), key=lambda i: (y[i], len(terms[i]), terms[i].sum(dtype=np.int64)))  # the same model at any partitioning
    base = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).agg(F.avg(label_col)).first()[0]
    return fit_machine([terms[i] for i in order], y[order] if len(y) else y, base=base)


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row, repeated rows too.

    A null or empty text has no terms and gets the score of the bias alone. Whole texts are scored, however long. An empty
    table gives an empty result. Only the named columns are read, so other columns can have any names.
    """
    return score_rows(docs, machine, threshold, id_col, text_col)
