"""Dictionaries that are learned from the catalogue and from known pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import attrs, text
from quarry.functions.lexicon import AGE_WORDS, COLOURS, GENDER_WORDS, MATERIAL, STOP_QUERY, UNKNOWN


def query_words(query: Column, least: int = 3) -> Column:
    return F.filter(text.without(text.tokens(query), STOP_QUERY), lambda t: F.length(t) >= least)


def category_phrases(items: DataFrame) -> DataFrame:
    """Distinct path segments: (phrase)."""
    return items.select(F.explode(attrs.segments(F.col("category"))).alias("phrase")).filter(F.col("phrase") != UNKNOWN).distinct()


def trusted_brands(items: DataFrame, least: int = 3) -> DataFrame:
    """(brand, n): of several words; or of one that is longer than two letters, in ``least`` items, and no common word."""
    words = category_phrases(items).select(F.explode(text.tokens(F.col("phrase"))).alias("brand")).distinct()
    counts = items.filter(F.col("brand") != UNKNOWN).groupBy("brand").agg(F.count("*").alias("n"))
    several = F.contains(F.col("brand"), F.lit(" "))
    one = counts.filter(~several & (F.col("n") >= least) & (F.length("brand") > 2) & ~F.col("brand").isin(*GENDER_WORDS, *AGE_WORDS, *COLOURS, *MATERIAL))
    return counts.filter(several).unionByName(one.join(words, "brand", "left_anti"))


def longest_phrase(terms: DataFrame, phrases: DataFrame, phrase: str, name: str, most: int = 3) -> DataFrame:
    """(term_id, name): the longest 1- to 3-gram of the query that is a phrase; of equal ones the first."""
    grams = terms.select("term_id", F.posexplode(text.word_ngrams(text.tokens(F.col("query")), most)).alias("i", "g"))
    hits = grams.join(phrases.select(F.col(phrase).alias("g")), "g")
    return hits.groupBy("term_id").agg(F.max_by("g", F.struct(F.length("g").alias("n"), -F.col("i"))).alias(name))


def brand_dictionary(pairs: DataFrame, terms: DataFrame, items: DataFrame, confidence: float = 0.7, queries: int = 3) -> DataFrame:
    """(token, brand, confidence, n_queries): words whose queries' positives mostly have one brand (its first word)."""
    first = F.try_element_at(text.tokens(F.col("brand")), F.lit(1))
    brands = pairs.join(items.select("item_id", first.alias("brand")), "item_id").filter(F.col("brand").isNotNull() & ~F.col("brand").isin("", "nan")).select("term_id", "brand").distinct()
    words = terms.join(pairs.select("term_id").distinct(), "term_id", "left_semi").select("term_id", F.explode(query_words(F.col("query"))).alias("token"))
    total = words.groupBy("token").agg(F.count("*").alias("n_queries"))
    best = words.join(brands, "term_id").groupBy("token", "brand").agg(F.count("*").alias("n"))
    best = best.withColumn("_r", F.row_number().over(W.partitionBy("token").orderBy(F.col("n").desc(), "brand"))).filter("_r = 1")
    out = best.join(total, "token").select("token", "brand", (F.col("n") / F.col("n_queries")).alias("confidence"), "n_queries")
    return out.filter((F.col("confidence") >= confidence) & (F.col("n_queries") >= queries))


def votes(pairs: DataFrame, terms: DataFrame, items: DataFrame, value: Column) -> DataFrame:
    """(token, value, n): how often a query word comes with a positive of that value."""
    words = terms.select("term_id", F.explode(F.array_distinct(query_words(F.col("query")))).alias("token"))
    return words.join(pairs, "term_id").join(items.select("item_id", value.alias("value")), "item_id").groupBy("token", "value").agg(F.count("*").alias("n"))


def vote(terms: DataFrame, counts: DataFrame, k: int, normalised: bool) -> DataFrame:
    """(term_id, value, votes, share, rank): the k best values of each query; ``normalised``: each word has one vote in all."""
    w = W.partitionBy("token")
    counts = counts.withColumn("w", F.col("n") / F.sum("n").over(w) if normalised else F.col("n").cast("double"))
    words = terms.select("term_id", F.explode(F.array_distinct(query_words(F.col("query")))).alias("token"))
    got = words.join(counts, "token").groupBy("term_id", "value").agg(F.sum("w").alias("votes"))
    of = W.partitionBy("term_id")
    got = got.withColumn("share", F.col("votes") / F.sum("votes").over(of))
    return got.withColumn("rank", F.row_number().over(of.orderBy(F.round("votes", 9).desc(), "value"))).filter(F.col("rank") <= k)


def product_vocabulary(items: DataFrame, least: int = 50) -> DataFrame:
    """(word): category words of three letters or more that occur in at least ``least`` items."""
    words = items.select(F.explode(text.tokens(F.replace(F.col("category"), F.lit("/"), F.lit(" ")))).alias("word")).filter(F.length("word") >= 3)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
