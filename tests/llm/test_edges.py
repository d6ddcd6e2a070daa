"""Nulls, empty and very long texts, repeated rows, empty tables and clashing names, for every operator and stage."""

import hashlib
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann, bpe, gif, html_text, licences, mixing, ngram_join, quality, sharding, toxicity

LONG = "word and other words are here " * 20_000
ROWS = [
    (1, "a b c d e f", "s1"), (1, "a b c d e f", "s1"), (2, "", "s1"), (3, None, "s2"), (4, " \n\t", None), (None, "x y z", "s2"), (5, LONG, "s2"),
    (6, "Licensed under CC BY-NC 4.0.\nmore text", None), (7, "a b c d e f", "s3"), (None, None, None), (8, "ünï çødé 日本語 🎉", "s1"),
]
#: Names that the operators use inside or return.
CLASH = ["size", "score", "key", "node", "row", "range", "taken", "slot", "shard", "_h", "edge", "cut", "n", "th", "label", "held_out", "text_crc32", "_doc", "_share"]
LABELS = [(i, i % 2, (i + 1) % 2) for i in range(1, 9)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([*LABELS, (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def runs(docs, labels):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return {
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "sharding": lambda d: sharding.shard(d, 4),
        "quality": lambda d: quality.score(d, quality.train(d, labels)),
        "licences": licences.scan,
        "bpe": lambda d: bpe.encode_texts(d, path, public_tokenizers.PATTERN),
        "gif": gif.store_texts,
        "jaccard": lambda d: ngram_join.jaccard_components(d, 3, 90, 100),
        "mixing": mixing.mix,
    }


NAMES = ["toxicity", "sharding", "quality", "licences", "bpe", "gif", "jaccard", "mixing"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each_row(spark, docs, labels, name):
    got = runs(docs, labels)[name](docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, labels, name):
    assert runs(docs, labels)[name](docs.filter("false")).count() == 0


def test_scores_of_empty_texts_are_in_range(spark, docs, labels):
    for module in (toxicity, quality):
        for r in module.score(docs, module.train(docs, labels)).collect():
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD)
            want = r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2
            assert r.held_out == want
        none = module.train(docs, labels.filter("false"))
        assert {r.score for r in module.score(docs, none).collect()} == {0.5}


def test_sharding_values(spark, docs):
    rows = sharding.shard(docs, 4).collect()
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 4
    by = {r.doc_id: r for r in rows}
    assert (by[3].size, by[3].text_crc32) == (1, 0) and by[8].size == len("ünï çødé 日本語 🎉".encode()) + 1
    assert by[1].shard == by[7].shard
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_jaccard_values(spark, docs):
    got = {r.doc_id: r for r in ngram_join.jaccard_components(docs, 3, 90, 100).collect()}
    assert got[7].component_id == 1 and got[7].n_shingles == 4
    assert (got[2].n_shingles, got[2].component_id, got[4].n_shingles, got[3].component_id) == (0, 2, 0, 3)


def test_one_of_each_keeps_columns_and_first_rows(spark, docs):
    kept = ngram_join.one_of_each(docs, 3, 90, 100)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 7 not in ids and {2, 3, 4, 5, 6, 8} <= set(ids) and ids.count(None) == 2


def test_mixed_keeps_columns(spark, docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    copies = {}
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert {k: v for k, v in copies.items() if v} == got
    assert mixing.mixed(docs.filter("false")).count() == 0


def test_bpe_and_gif_of_null_are_those_of_empty(spark, docs):
    got = {r.doc_id: r for r in bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (got[3].n_tokens, got[3].ids_sha256, got[3].decoded_sha256) == (0, empty, empty) == (got[2].n_tokens, got[2].ids_sha256, got[2].decoded_sha256)
    assert got[5].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    g = {r.doc_id: r for r in gif.store_texts(docs).collect()}
    assert g[3].payload_bytes == 576 and g[3].n_bytes == 0 and g[3].tail_crc32 == zlib.crc32(b"\xff" * 32)
    assert g[1].media_sha256 == g[7].media_sha256


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<article><p>Good &amp; short.</p></article>"), (None, "u", "<p"), (3, "u", "<article><p>Good &amp; short.</p></article>")], "page_id long, url string, html string")
    rows = html_text.extract(pages.withColumn("text", F.lit("clash"))).collect()
    assert sorted(r.text for r in rows) == ["", "", "", "Good & short.", "Good & short."]
    assert all(r.n_chars == len(r.text) for r in rows)
    assert html_text.extract(pages.filter("false")).count() == 0


def test_ann_edges(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (1, [1.0, 0.0]), (2, [0.5, float("nan")]), (3, [None, 1.0]), (4, [0.0, 1.0]), (4, [0.0, 1.0]), (None, [1.0, 1.0]), (5, [float("inf"), 1.0]), (150, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.nearest(df, F.col("vec_id") % 50 == 0, 5).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 150, 0.707107), (0, 3, 4, 0.0), (150, 1, 0, 0.707107), (150, 2, 1, 0.707107), (150, 3, 4, 0.707107)]
    assert ann.nearest(df.filter("false"), F.col("vec_id") % 50 == 0, 5).count() == 0
