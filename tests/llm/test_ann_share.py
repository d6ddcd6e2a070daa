"""Recall and share of the entries that the probes visit, as the number of entries grows; outside Spark, with the operator's own tables."""

import numpy as np
import pytest

from quarry.llm import ann


def measure(m, queries, k=5):
    """(recall at k, visited share): first the common scale, then for far queries that of their own k-th hit."""
    unit, tables = ann._unit(m), ann.Tables(m.shape[1], len(m))
    score = unit[queries] @ unit.T
    score[np.arange(len(queries)), queries] = -9
    true = np.argsort(-score, axis=1)[:, :k]
    scale = float(np.median(np.sqrt(2 - 2 * np.take_along_axis(score, true, 1)[: ann.SAMPLE, -1])))
    keys, places = tables.key(np.floor(tables.places(unit))), tables.places(unit[queries])
    seen = np.zeros(score.shape, bool)
    for i in range(len(queries)):
        for reach in (scale, None):
            if reach is None:
                last = np.sort(np.where(seen[i], score[i], -9))[-k]
                reach = float(np.sqrt(max(0.0, 2 - 2 * last)))
                if last == -9 or reach <= scale:
                    break
            for t in range(ann.TABLES):
                seen[i] |= np.isin(keys[t], tables.key(np.array(tables.probes(places[t, i], reach))))
    return np.take_along_axis(seen, true, 1).mean(), seen.mean()


def test_share_falls_as_rows_grow():
    m = np.random.default_rng(0).normal(size=(50_000, 64))  # no structure at all: the worst case
    got = [measure(m[:n], np.arange(0, n, step)) for n, step in ((500, 10), (2000, 20), (50_000, 500))]
    assert all(recall >= 0.88 for recall, _ in got) and sum(recall for recall, _ in got) >= 2.7
    shares = [share for _, share in got]
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.5


@pytest.mark.parametrize("copies", [1, 25])
def test_clusters_are_pruned(copies):
    rng = np.random.default_rng(3)
    m = np.repeat(rng.normal(size=(2000, 64)), 25 // copies, axis=0) + 0.4 * rng.normal(size=(2000 * (25 // copies), 64))
    recall, share = measure(m, np.arange(0, len(m), len(m) // 100))
    assert recall >= 0.9 and (copies > 1 or share < 0.15)
