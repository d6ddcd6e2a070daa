"""Stages of the pipeline: on odd documents, and against the operators they apply."""

import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import bpe, ngram_join, quality, toxicity

DIR = "/root/testdata/sf0.001"
ROWS = [(1, "a b c d e f g", "en", "s1", 13), (1, "a b c d e f g", "en", "s1", 13), (2, "", None, "s1", 0), (3, None, None, None, None), (None, "x y", "en", "s2", 3), (4, "word " * 30_000, "en", None, 150_000)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(c) for c in ("score", "size", "key", "_doc", "range")])


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_odd_documents(spark, odd, name, stage):
    for docs in (odd, odd.filter("false")):
        out = stage(spark, docs, DIR)
        n = out.count()
        assert n <= 3 * docs.count()
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns
        else:
            assert n == docs.count()


def test_stages_are_the_operators_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "mixing", "byte_bpe"]


@pytest.mark.parametrize(("stage", "module", "label", "keep"), [(corpus_pipeline.drop_toxic, toxicity, "toxic", 0), (corpus_pipeline.keep_good, quality, "quality", 1)])
def test_filters_follow_the_scores(spark, stage, module, label, keep):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    want = {r.doc_id for r in module.score(docs, module.train(docs, labels, label)).collect() if r.predicted == keep}
    assert {r.doc_id for r in stage(spark, docs, DIR).select("doc_id").collect()} == want


def test_near_copies_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r.doc_id, ngram_join.shingles(r.text, 5)) for r in docs.select("doc_id", "text").collect()]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(rows):
        for b, y in rows[k + 1 :]:
            common = len(x & y)
            if common and 100 * common >= 80 * (len(x) + len(y) - common):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    kept = corpus_pipeline.drop_near_copies(spark, docs, DIR)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i in parent if find(i) == i)


def test_run_encodes_what_is_left(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = corpus_pipeline.run(spark, DIR).collect()
    plain = {r.doc_id: r for r in bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    assert 0 < len(out) <= 3 * docs.count()
    assert all(r == plain[r.doc_id] for r in out)


def test_mix_of_the_stage_against_its_definition(spark):
    """Each source's words after the stage come near the target of capped water-filling, computed by handing out again and again."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = [(r.source, size(r.text)) for r in docs.collect()]
    have: dict = {}
    for s, n in rows:
        have[s] = have.get(s, 0) + n
    order = sorted((s for s in have if s is not None)) + [s for s in have if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(have.values())), dict(weight)
    while True:
        total = sum(open_.values())
        over = [s for s in open_ if left * open_[s] / total > 3 * have[s] + 1e-9]
        if not over:
            target |= {s: left * w / total for s, w in open_.items()}
            break
        for s in over:
            target[s] = 3.0 * have[s]
            del open_[s]
        left = sum(have.values()) - sum(target.values())
    out = corpus_pipeline.mix_sources(spark, docs, DIR)
    taken: dict = {}
    times: dict = {}
    for r in out.collect():
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    largest = max(n for _, n in rows)
    assert all(abs(taken.get(s, 0) - t) <= largest for s, t in target.items()) and max(times.values()) <= 3
