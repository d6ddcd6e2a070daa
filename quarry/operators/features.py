"""Whole feature frames of pairs, each as one select over tokens that are made once for each term and each item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import attrs, signals, similarity, text
from quarry.functions import lexicon as L
from quarry.operators import dictionary, weights

c = F.col


def pair_features(pairs: DataFrame, terms: DataFrame, items: DataFrame, scores: DataFrame | None = None, cosines: DataFrame | None = None, vocabulary: int | None = None) -> DataFrame:
    """term_id, item_id and 42 features. ``vocabulary``: only so many of the most frequent terms get TF-IDF weights; all, if not given.
    ``scores`` and ``cosines`` (term_id, item_id, score) come from encoders; without them these features are 0."""
    asked = terms.select("query").distinct().withColumn("term_id", c("query"))  # what a text tells is worked out once for all terms that ask it
    brand = dictionary.longest_phrase(asked, dictionary.trusted_brands(items), "brand", "qbrand")
    phrase = dictionary.longest_phrase(asked, dictionary.category_phrases(items), "phrase", "qcat")
    texts = terms.select(c("query").alias("_x")).unionAll(items.select("title")).groupBy("_x").agg(F.count("*").alias("times"))
    terms_of = lambda ws: F.concat(ws, text.bigrams(ws))
    vectors = weights.vectors(texts, "_x", terms_of(weights.words(c("_x"))), 2, vocabulary, "times")
    # a pair is shuffled with lines of its query, not with lists, and is matched to nothing after its item: tokens, cosine and ratios follow from the row
    other = lambda ws, text: F.when(F.array_join(ws, " ") != text, F.array_join(ws, " "))  # a line only where it differs from the text
    t = asked.select("term_id", "query", text.tokens(c("query")).alias("q")).join(brand, "term_id", "left").join(phrase, "term_id", "left")
    t = t.join(vectors.select(c("_x").alias("query"), "norm"), "query", "left").select(
        c("query").alias("_text"), "qbrand", "qcat", "norm", other(c("q"), c("query")).alias("_q"), other(text.stems(c("q")), c("query")).alias("_s"), other(similarity.plain_tokens(c("query")), c("query")).alias("_p"),
        other(weights.words(c("query")), c("query")).alias("_t"), signals.query_colour(c("q")).alias("qc"),
    )
    t = terms.select("term_id", "query").join(t, c("query").eqNullSafe(c("_text"))).drop("_text")
    a, values = c("attributes"), text.tokens(attrs.values_text(c("attributes")))
    i = items.join(vectors.select(c("_x").alias("title"), "parts"), "title", "left").select(
        "*", text.tokens(c("title")).alias("tt"), text.tokens(F.replace(c("category"), F.lit("/"), F.lit(" "))).alias("ct"), attrs.value_of(a, "renk").alias("colour"),
        attrs.value_of(a, "materyal bileşeni", "materyal").alias("material"), attrs.value_of(a, "kol boyu", "kol tipi").alias("sleeve"), (F.size(attrs.entries(a)) > 0).alias("mapped"), text.tokens(a).alias("at"),
    )
    i = i.select("*", text.stems(c("tt")).alias("st"), text.stems(c("ct")).alias("sc"), similarity.brand_tokens(c("brand")).alias("bt"), F.when(c("mapped"), values).otherwise(c("at")).alias("av"), signals.codes(F.concat(c("tt"), c("at"))).alias("codes")).drop("attributes", "at")
    p = pairs.select("term_id", "item_id")
    for df, name in ((scores, "bert_score"), (cosines, "tyembed_cos")):
        p = p.join(df.select("term_id", "item_id", c("score").alias(name)), ["term_id", "item_id"], "left") if df is not None else p.withColumn(name, F.lit(0.0))
    p = p.join(t.hint("merge"), "term_id").join(i.hint("merge"), "item_id").withColumn("f", similarity.fuzzy(c("query"), c("title")))
    words = lambda x: F.filter(F.split(x, " "), lambda w: w != "")
    p = p.withColumns({name: words(F.coalesce(c(x), c("query"))) for name, x in (("q", "_q"), ("sq", "_s"), ("plain", "_p"), ("_ws", "_t"))})
    after = F.transform(F.slice(c("_ws"), 2, F.greatest(F.size("_ws") - 1, F.lit(0))), lambda w, i: F.concat(F.get(c("_ws"), i), F.lit(" "), w))
    p = p.withColumn("_g", F.concat("_ws", after)).withColumn("_w", F.transform("q", lambda w, i: F.struct(w.alias("w"), F.get(c("sq"), i).alias("s"))))
    p = p.withColumns({"head": similarity.head_of(c("_w")), "content": similarity.content_of(c("_w")), "product": similarity.product_of(c("_w")), "tfidf_cos": weights.dot(c("_g"), c("norm"), c("parts"))})
    q, tt, ct, query, first = c("q"), c("tt"), c("ct"), c("query"), F.try_element_at(c("q"), F.lit(1))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return p.select(
        "term_id", "item_id", "f.fuzz_partial", "f.fuzz_set", "f.fuzz_sort", "f.fuzz_basic", similarity.jaccard(q, tt).alias("jaccard"), "tfidf_cos",
        similarity.coverage(q, tt).alias("q_cov_title"), similarity.coverage(tt, q).alias("t_cov_query"), similarity.jaccard(q, ct).alias("cat_overlap"), flag(F.contains(c("title"), query)).alias("exact_in_title"),
        similarity.overlap(q, tt).alias("token_overlap"), similarity.contains_known(query, c("age_group")).alias("age_in_q"), similarity.jaccard(c("sq"), c("st")).alias("stem_jaccard"),
        similarity.jaccard(c("sq"), c("sc")).alias("stem_cat_jac"), signals.gender_cross(query, c("gender")).alias("gender_cross"), flag(F.contains(c("title"), first)).alias("first_tok_title"),
        flag((c("brand") != L.UNKNOWN) & F.contains(c("brand"), first)).alias("first_tok_brand"), F.size(q).alias("q_len"), F.size(tt).alias("t_len"), F.coalesce("bert_score", F.lit(0.0)).alias("bert_score"),
        attrs.level(c("category"), 0).alias("ana_kategori"), signals.colour_match(c("qc"), c("colour")).alias("color_typed"), c("qc").isNotNull().cast("double").alias("has_q_color"),
        (c("colour") != "").cast("double").alias("attr_has_renk"), similarity.brand_overlap(query, c("brand"), c("bt"), c("plain")).alias("brand_tok_ovlp"), signals.material_match(q, c("material")).alias("material_match"),
        signals.sleeve_match(query, c("sleeve")).alias("kol_boyu_match"), similarity.jaccard(q, c("av")).alias("attr_jac_fixed"), F.when(c("mapped"), similarity.coverage(q, c("av"))).otherwise(0.0).alias("attr_q_cov"),
        similarity.head_match(q, tt, word_stems=c("st"), head=c("head")).alias("head_in_title"), similarity.weighted_coverage(q, tt, word_stems=c("st"), content=c("content")).alias("weighted_q_cov"), similarity.head_match(q, ct, word_stems=c("sc"), head=c("head")).alias("head_in_cat"),
        similarity.product_cover(query, q, tt, c("brand"), word_stems=c("st"), product=c("product"), brand_words=c("bt"), plain=c("plain")).alias("product_type_cover"), similarity.subset(q, tt).alias("all_q_in_title"), similarity.brand_weight(q, c("brand"), c("bt")).alias("brand_weight"),
        F.coalesce("tyembed_cos", F.lit(0.0)).alias("tyembed_cos"), signals.phrase_signal(c("qbrand"), c("brand"), True).alias("trusted_brand_mismatch"), signals.phrase_signal(c("qcat"), c("category"), False).alias("category_phrase_match"),
        signals.age_cross(query, c("age_group")).alias("age_cross"), signals.material_mismatch(q, c("material")).alias("material_mismatch"), signals.query_type(query, c("qbrand"), c("qcat")).alias("query_type"),
        signals.code_match(q, c("codes")).alias("spec_code_match"),
    )


def labeler_features(pairs: DataFrame, terms: DataFrame, items: DataFrame, scores: DataFrame | None = None, cosines: DataFrame | None = None) -> DataFrame:
    """term_id, item_id and 37 features on ASCII-folded tokens; short attributes count as text."""
    t = terms.select("term_id", text.fold(c("query")).alias("query")).withColumn("q", text.ascii_tokens(c("query")))
    f = lambda x: text.ascii_tokens(x)
    i = items.select(
        "item_id", text.fold(c("title")).alias("title"), "brand", "gender", "age_group", f(c("title")).alias("tt"), f(c("brand")).alias("bt"), f(c("category")).alias("ct"),
        attrs.short_text(c("attributes")).alias("short"),
    ).withColumn("at", f(c("short")))
    given = lambda df, name: (df.select("term_id", "item_id", c("score").alias(name)) if df is not None else pairs.select("term_id", "item_id", F.lit(0.0).alias(name)))
    p = pairs.select("term_id", "item_id").join(t, "term_id").join(i, "item_id").join(given(scores, "bert_score"), ["term_id", "item_id"], "left").join(given(cosines, "cosine"), ["term_id", "item_id"], "left")
    fuzzy = pairs.join(t, "term_id").join(i, "item_id").select("query", "title").distinct().select("query", "title", similarity.fuzzy(c("query"), c("title")).alias("fz"))  # distinct pairs of texts
    p = p.withColumn("target", F.concat("tt", "bt", "ct", "at")).join(fuzzy, ["query", "title"])
    q, tt, bt, ct, at, target = (c(x) for x in ("q", "tt", "bt", "ct", "at", "target"))
    head, first = text.head_noun(q, tuple(L.FOLDED_STOP)), F.try_element_at(q, F.lit(1))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    some = lambda ws: flag(F.arrays_overlap(q, F.array(*[F.lit(w) for w in ws])))
    return p.select(
        "term_id", "item_id", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), F.coalesce("bert_score", F.lit(0.0)).alias("bert_score"), F.size(q).alias("q_len"), F.size(tt).alias("t_len"), F.size(bt).alias("brand_len"),
        F.size(ct).alias("cat_len"), similarity.overlap(q, tt).alias("token_overlap"), similarity.overlap(q, target).alias("target_overlap"), similarity.jaccard(q, tt).alias("jaccard_title"),
        similarity.jaccard(q, target).alias("jaccard_target"), similarity.coverage(q, tt).alias("q_cov_title"), similarity.coverage(q, target).alias("q_cov_target"), similarity.coverage(tt, q).alias("t_cov_query"),
        similarity.coverage(q, ct).alias("cat_cov"), similarity.coverage(q, at).alias("attr_cov"), similarity.coverage(bt, q).alias("brand_cov_query"), similarity.coverage(bt, tt).alias("brand_cov_title"),
        similarity.coverage(q, bt).alias("query_brand_cov"), flag((c("query") != "") & F.contains(c("title"), c("query"))).alias("exact_in_title"), flag((F.size(q) > 0) & (F.size(F.array_except(q, tt)) == 0)).alias("all_q_in_title"),
        flag(F.array_contains(tt, head)).alias("head_in_title"), flag(F.array_contains(ct, head)).alias("head_in_cat"), flag(F.array_contains(tt, first)).alias("first_tok_title"), flag(F.array_contains(bt, first)).alias("first_tok_brand"),
        c("fz.fuzz_basic").alias("fuzz_ratio"), "fz.fuzz_partial", "fz.fuzz_sort", "fz.fuzz_set", signals.folded_gender(c("query"), c("gender"), c("title")).alias("gender_signal"), signals.folded_age(c("query"), c("age_group"), c("title")).alias("age_signal"),
        signals.folded_colour(c("query"), F.array_join(target, " ")).alias("color_signal"), signals.code_match(q, F.concat(tt, at), True).alias("spec_code_match"), signals.folded_product_cover(c("query"), c("title"), c("brand")).alias("product_cover"),
        flag(F.exists(q, lambda w: w.rlike("[0-9]"))).alias("has_code"), some(L.FOLDED_COLOURS).alias("has_color"), some(L.FOLDED_GENDER).alias("has_gender"), some(L.FOLDED_AGE).alias("has_age"),
    )
