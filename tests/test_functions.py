"""Scalar goldens and properties."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import attrs, signals, similarity, text
from quarry.operators import parse


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize(("word", "stem"), [("evler", "evler"), ("evde", "evd"), ("oya", "oya"), ("çantaları", "çanta"), ("kitaplar", "kitap"), ("a", "a")])
def test_stem(spark, word, stem):
    assert one(spark, text.stem(F.col("w")), w=word) == stem


def test_lower(spark):
    assert one(spark, text.lower_tr(F.col("w")), w=" İIŞĞÜÖÇ ") == "iışğüöç"
    assert one(spark, text.fold(F.col("w")), w="Şık  ÇİÇEK ") == "sik cicek"


def test_tokens_of_empty_texts(spark):
    assert one(spark, text.tokens(F.col("w")), w="  ") == []
    assert one(spark, text.head_noun(text.tokens(F.col("w"))), w="") == ""
    assert one(spark, text.word_ngrams(text.tokens(F.col("w"))), w="") == []


def test_attributes(spark):
    a = "renk: siyah, materyal: a:b, foo, renk : mavi"
    assert one(spark, attrs.value_of(F.col("a"), "renk"), a=a) == "mavi"
    assert one(spark, attrs.value_of(F.col("a"), "none", "materyal"), a=a) == "a:b"
    assert one(spark, attrs.short_text(F.col("a")), a=a) == "renk:mavi; materyal:a:b"
    assert one(spark, F.size(attrs.entries(F.col("a"))), a="unknown") == 0


@pytest.mark.parametrize(("q", "item", "want"), [("gold", "altın", 2.0), ("gold", "mavi", -1.0), ("gold", "", 0.0), ("lacivert", "mavi", 1.0), ("çanta", "mavi", 0.0)])
def test_colour(spark, q, item, want):
    assert one(spark, signals.colour_match(signals.query_colour(text.tokens(F.col("q"))), F.col("i")), q=q, i=item) == want


@pytest.mark.parametrize(("q", "title", "want"), [("a54 kılıf", "samsung a54", 1.0), ("a54 kılıf", "samsung a34", -1.0), ("a54 kılıf", "samsung", -1.0), ("kılıf", "a54", 0.0)])
def test_codes(spark, q, title, want):
    assert one(spark, signals.code_match(text.tokens(F.col("q")), text.tokens(F.col("t"))), q=q, t=title) == want


@pytest.mark.parametrize(("g", "want"), [("kadın", -1.0), ("erkek", 1.0), ("unisex", 0.0)])
def test_gender(spark, g, want):
    assert one(spark, signals.gender_cross(F.col("q"), F.col("g")), q="erkek bot", g=g) == want


def test_stem_jaccard(spark):
    a, b = text.tokens(F.col("a")), text.tokens(F.col("b"))
    v = {"a": "çocuk oyuncağı", "b": "çocuklar için oyuncaklar"}
    assert one(spark, similarity.jaccard(a, b), **v) == 0
    assert one(spark, similarity.jaccard(text.stems(a), text.stems(b)), **v) == 0.25


def test_sizes(spark):
    assert one(spark, parse.sizes(F.col("q")), q="şampuan 500 ml 2.5lt xl no 38") == ["500ml", "2.5lt", "38numara", "xltekstil_beden"]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@given(st.text("abc ", max_size=20), st.text("abc ", max_size=20))
def test_fuzzy_properties(a, b):
    assert similarity.lcs(a, b) == slow_lcs(a, b)
    for f in (similarity.ratio, similarity.partial_ratio, similarity.token_sort_ratio, similarity.token_set_ratio):
        assert 0 <= f(a, b) <= 1
        assert f(a, b) == pytest.approx(f(b, a))
    assert similarity.ratio(a, a) == 1


def test_fuzzy_goldens():
    assert similarity.ratio("this is a test", "this is a test!") == pytest.approx(28 / 29)
    assert similarity.partial_ratio("test", "this is a test!") == 1
    assert similarity.token_sort_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 1
    assert similarity.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1
