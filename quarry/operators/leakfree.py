"""The feature frame whose vectorisers see training texts only: word and character TF-IDF over several fields, flags and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import attrs, text
from quarry.functions.lexicon import UNKNOWN
from quarry.operators import weights

c = F.col

# The words by which a query names a gender or an age.
MALE, FEMALE = ("erkek",), ("kadın", "kız", "bayan")
BABY, CHILD, YOUNG, ADULT = "bebek", "çocuk", "genç", "yetişkin"


def any_of(x: Column, *needles: str) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(x, F.lit(n))
    return out


def fields(items: DataFrame) -> DataFrame:
    """Items with normalised fields, main, category_text and item_text; empty fields are unknown."""
    own = ["title", "category", "brand", "gender", "age_group"]
    norm = lambda n: text.lower_tr_dotless(F.coalesce(c(n), F.lit("")))
    i = items.select("item_id", *[F.when(norm(n) == "", UNKNOWN).otherwise(norm(n)).alias(n) for n in own])
    i = i.select("*", attrs.level(c("category"), 0).alias("main_category"), F.replace(c("category"), F.lit("/"), F.lit(" ")).alias("category_text"))
    return i.withColumn("item_text", F.concat_ws(" ", "title", "category_text", "brand", "gender", "age_group"))


def gender_flags(query: Column, gender: Column) -> tuple[Column, Column]:
    """(match, conflict)"""
    man, woman = any_of(query, *MALE), any_of(query, *FEMALE)
    return (man & (gender == MALE[0])) | (woman & (gender == FEMALE[0])), (man & (gender == FEMALE[0])) | (woman & (gender == MALE[0]))


def age_flags(query: Column, age: Column) -> tuple[Column, Column]:
    """(match, conflict)"""
    both = [any_of(query, w) & any_of(age, w) for w in (BABY, CHILD, YOUNG, ADULT)]
    conflict = (any_of(query, BABY, CHILD) & age.isin(ADULT, YOUNG)) | (any_of(query, ADULT, YOUNG) & any_of(age, BABY))
    return both[0] | both[1] | both[2] | both[3], conflict


def weight_maps(texts: DataFrame, grams: Column, vocabulary: int | None = None) -> DataFrame:
    """(text, m): the weights of each distinct text's n-grams as a map by 64-bit hash, which compares faster than text; texts without a known n-gram are missing."""
    texts = texts.select("text").distinct()
    w = weights.tfidf(texts, texts, "text", grams, 2, vocabulary)
    return w.groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct(F.xxhash64("term"), "w"))).alias("m"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two weight maps: only their common keys, found by a hash set, are looked up."""
    both = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.coalesce(F.aggregate(both, F.lit(0.0), lambda s, k: s + F.try_element_at(a, k) * F.try_element_at(b, k)), F.lit(0.0))


def codes(items: DataFrame, column: str) -> DataFrame:
    """(column, column_code): places of the distinct values in order; a table of the values, not of the items."""
    return items.select(column).distinct().withColumn(f"{column}_code", F.row_number().over(W.orderBy(column)) - 1)


def leak_free_features(pairs: DataFrame, terms: DataFrame, items: DataFrame, word_vocabulary: int | None = None, char_vocabulary: int | None = None) -> DataFrame:
    """term_id, item_id and 20 features. The vocabularies come from the terms and items of ``pairs`` and hold n-grams of two texts or more.

    Words are runs of two or more lower-case letters and digits. ``..._vocabulary``: only so many of the most frequent n-grams; all, if not given. Weights are made once for each text and
    carried as maps, so pairs are never multiplied by their n-grams.
    """
    pairs = pairs.select("term_id", "item_id")
    t = terms.join(pairs.select("term_id").distinct(), "term_id", "left_semi").select("term_id", text.lower_tr_dotless(F.coalesce(c("query"), F.lit(""))).alias("query"))
    i = fields(items.join(pairs.select("item_id").distinct(), "item_id", "left_semi"))
    words = text.word_tokens(c("text"))
    of = lambda df, *names: [df.select(c(n).alias("text")) for n in names]
    parts = [*of(t, "query"), *of(i, "title", "category_text", "item_text")]
    word = weight_maps(parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]), F.concat(words, text.bigrams(words)), word_vocabulary)
    char = weight_maps(parts[0].unionAll(parts[1]), text.char_ngrams(text.tokens(c("text"))), char_vocabulary)
    with_map = lambda df, name, maps, alias: df.join(maps.select(c("text").alias(name), c("m").alias(alias)), name, "left")
    t = with_map(with_map(t, "query", word, "qw"), "query", char, "qc")
    for name, maps, alias in (("title", word, "tw"), ("category_text", word, "cw"), ("item_text", word, "iw"), ("title", char, "tc")):
        i = with_map(i, name, maps, alias)
    for name in ("main_category", "gender", "age_group"):
        i = i.join(codes(i, name), name)
    p = pairs.join(t, "term_id").join(i, "item_id")
    keys = lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<long>"))
    q, title, size = c("query"), c("title"), lambda x: F.length(x).cast("double")
    p = p.withColumn("_o", F.size(F.array_intersect(keys(c("qw")), keys(c("iw")))).cast("double")).withColumn("_q", F.size(keys(c("qw")))).withColumn("_i", F.size(keys(c("iw"))))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    gm, gc = gender_flags(q, c("gender"))
    am, ac = age_flags(q, c("age_group"))
    inside = lambda hay, needle, least: flag((F.length(needle) >= least) & (needle != UNKNOWN) & F.contains(hay, needle))
    return p.select(
        "term_id", "item_id", dot(c("qw"), c("tw")).alias("word_cos_title"), dot(c("qw"), c("cw")).alias("word_cos_category"), dot(c("qw"), c("iw")).alias("word_cos_item"), dot(c("qc"), c("tc")).alias("char_cos_title"),
        c("_o").alias("overlap_count"), (c("_o") / (c("_q") + 1e-6)).alias("overlap_query_ratio"), (c("_o") / (c("_q") + c("_i") - c("_o") + 1e-6)).alias("overlap_jaccard"), size(q).alias("query_len"), size(title).alias("title_len"),
        F.abs(size(q) - size(title)).alias("len_abs_diff"), (F.least(size(q), size(title)) / (F.greatest(size(q), size(title)) + 1e-6)).alias("len_ratio"), inside(q, c("brand"), 2).alias("brand_in_query"), inside(title, q, 4).alias("query_in_title"),
        flag(gm).alias("gender_match"), flag(gc).alias("gender_conflict"), flag(am).alias("age_match"), flag(ac).alias("age_conflict"), "main_category_code", "gender_code", "age_group_code",
    )
