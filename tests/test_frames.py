"""The whole feature frames, column by column: against the queries that SQL checks, and against plain Python for the fuzzy ones."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import similarity
from quarry.plans import extras, further, models, relational, text_features  # noqa: F401
from quarry.plans.adapters import Tables
from quarry.plans.registry import QUERIES

DIR = "/root/testdata/sf0.001"
FUZZY = {"fuzz_partial": similarity.partial_ratio, "fuzz_set": similarity.token_set_ratio, "fuzz_sort": similarity.token_sort_ratio}
#: Columns that only the frame names so.
ALIAS = {"attr_jac_fixed": "attr_jac"}


@pytest.mark.parametrize(("frame", "queries", "least"), [
    ("pair_feature_frame", ["lexical_similarity", "head_coverage", "brand_and_product", "attribute_overlap", "typed_signals", "phrase_signals"], 28),
    ("labeler_feature_frame", ["folded_signals", "folded_age_signal"], 2),
])
def test_frame_equals_the_checked_queries(spark, frame, queries, least):
    got = QUERIES[frame](spark, DIR)
    got = got.select(*[F.col(c).alias(ALIAS.get(c, c)) for c in got.columns]).toPandas().set_index(["term_id", "item_id"]).sort_index()
    seen = set()
    for q in queries:
        want = QUERIES[q](spark, DIR).toPandas().set_index(["term_id", "item_id"]).sort_index()
        assert list(want.index) == list(got.index)
        for col in want.columns:
            if col in got.columns and col != "color_signal":  # the frame looks for colours in all words of the item
                seen.add(col)
                assert (got[col].astype(float) - want[col].astype(float)).abs().max() < 1e-8, col
    assert len(seen) >= least, sorted(seen)


def test_fuzzy_and_lengths_of_the_frames(spark):
    t = Tables(spark, DIR)
    texts = t.pairs.join(t.terms, "term_id").join(t.items, "item_id").select("term_id", "item_id", "query", "title").collect()
    frame = {(r.term_id, r.item_id): r for r in QUERIES["pair_feature_frame"](spark, DIR).collect()}
    assert len(frame) == len(texts)
    for r in texts[::7]:
        f = frame[r.term_id, r.item_id]
        for name, ratio in FUZZY.items():
            assert f[name] == pytest.approx(ratio(r.query, r.title), abs=1e-12)
        assert f.fuzz_basic == pytest.approx(similarity.ratio(r.query, r.title), abs=1e-12)
        assert (f.q_len, f.t_len) == (len(r.query.split()), len(r.title.split()))


def test_labeler_frame_on_folded_tokens(spark):
    from quarry.functions import text

    t = Tables(spark, DIR)
    rows = t.pairs.join(t.terms, "term_id").join(t.items, "item_id")
    rows = rows.select("term_id", "item_id", text.ascii_tokens(F.col("query")).alias("q"), text.ascii_tokens(F.col("title")).alias("tt"), text.ascii_tokens(F.col("brand")).alias("bt"), text.ascii_tokens(F.col("category")).alias("ct")).collect()
    frame = {(r.term_id, r.item_id): r for r in QUERIES["labeler_feature_frame"](spark, DIR).collect()}
    share = lambda a, b: len(set(a) & set(b)) / len(set(a)) if a else 0.0
    for r in rows:
        f = frame[r.term_id, r.item_id]
        assert (f.q_len, f.t_len, f.brand_len, f.cat_len) == (len(r.q), len(r.tt), len(r.bt), len(r.ct))
        assert f.jaccard_title == pytest.approx(len(set(r.q) & set(r.tt)) / len(set(r.q) | set(r.tt)))
        assert f.q_cov_title == pytest.approx(share(r.q, r.tt)) and f.cat_cov == pytest.approx(share(r.q, r.ct)) and f.brand_cov_title == pytest.approx(share(r.bt, r.tt))
        assert f.all_q_in_title == float(set(r.q) <= set(r.tt)) and f.has_code == float(any(any(ch.isdigit() for ch in w) for w in r.q))
