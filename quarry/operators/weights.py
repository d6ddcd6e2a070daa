"""Term weights in long tables: idf, TF-IDF cosine, BM25. Texts are weighed once each, then joined on (id, term)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text

#: Words of two characters or more; the class is spelled out so that every engine reads it alike.
WORD = r"[0-9a-zA-Z_À-ɏ]{2,}"

#: Distinct terms of the queries up to which they are broadcast.
QUERY_TERMS = 1_000_000


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def counts(df: DataFrame, key: str, terms: Column, *kept: str) -> DataFrame:
    """(key, term, tf), and the columns ``kept``, which are those of the key."""
    return df.select(key, *kept, F.explode(terms).alias("term")).groupBy(key, *kept, "term").agg(F.count("*").alias("tf"))


def idf_sets(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """(term, df, idf) over sets of terms: ln((N - df + 0.5) / (df + 0.5) + 1)."""
    n = df.agg(F.count("*").alias("n_docs"))
    got = df.select(key, F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return got.crossJoin(F.broadcast(n)).select("term", "df", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))  # one row


def weighed(fit: DataFrame, apply: DataFrame, key: str, terms: Column, least: int = 2, most: int | None = None, times: str | None = None) -> DataFrame:
    """(key, term, idf, w): (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), the latter as ``idf``; not of unit length.

    The vocabulary comes from ``fit``: terms in ``least`` texts or more, the ``most`` most frequent ones (ties by term). ``times``: a column of ``fit``
    that says how many equal texts a row stands for.
    """
    tf = counts(fit, key, terms, *([times] if times else []))
    each = F.col(times) if times else F.lit(1)
    df = tf.groupBy("term").agg(F.sum(each).alias("df"), F.sum(F.col("tf") * each).alias("total")).filter(F.col("df") >= least)
    if most:
        df = df.orderBy(F.col("total").desc(), "term").limit(most)
    n = fit.agg(F.coalesce(F.sum(each), F.lit(0)).alias("n_docs"))
    idf = df.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    own = tf if apply is fit else counts(apply, key, terms)
    return own.join(idf, "term").select(key, "term", "idf", ((1 + F.log("tf")) * F.col("idf")).alias("w"))


def tfidf(fit: DataFrame, apply: DataFrame, key: str, terms: Column, least: int = 2, most: int | None = None, times: str | None = None) -> DataFrame:
    """(key, term, w) of ``weighed``, of unit length for each text of ``apply``."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))
    return weighed(fit, apply, key, terms, least, most, times).select(key, "term", (F.col("w") / norm).alias("w"))


def vectors(texts: DataFrame, text: str, terms: Column, least: int = 2, most: int | None = None, times: str | None = None) -> DataFrame:
    """(text, norm, parts): the length of each text's TF-IDF vector, and by term the unit weight times the idf.

    The cosine with a text of which only the terms and ``norm`` are at hand is ``dot``: nothing but a number travels with it.
    """
    own = weighed(texts, texts, text, terms, least, most, times).groupBy(text)
    got = own.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.map_from_entries(F.collect_list(F.struct("term", (F.col("w") * F.col("idf")).alias("x")))).alias("_m"))
    return got.select(text, "norm", F.transform_values("_m", lambda _, x: x / F.col("norm")).alias("parts"))


def dot(terms: Column, norm: Column, parts: Column) -> Column:
    """Cosine of a text, given by its terms with repeats and ``norm``, with one given by ``parts``; 0 where either has no weight. ``terms`` should be a column that is made already."""
    once, own = F.array_distinct(terms), lambda t: F.coalesce(F.try_element_at(parts, t), F.lit(0.0))
    plain = F.aggregate(terms, F.lit(0.0), lambda a, t: a + own(t))
    repeated = F.aggregate(once, F.lit(0.0), lambda a, t: a + own(t) * (1 + F.log(F.size(F.filter(terms, lambda x: x == t)).cast("double"))))
    total = F.when(F.size(once) == F.size(terms), plain).otherwise(repeated)
    return F.coalesce(total / norm, F.lit(0.0))


def cosine(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, score) of all pairs that share a term, by an inverted index."""
    return left.select(a, "term", F.col("w").alias("_l")).join(right.select(b, "term", F.col("w").alias("_r")), "term").groupBy(a, b).agg(F.sum(F.col("_l") * F.col("_r")).alias("score"))


def bm25(docs: DataFrame, queries: DataFrame, doc: str, query: str, doc_terms: Column, query_terms: Column, k1: float = 1.5, b: float = 0.75, eps: float = 0.25) -> DataFrame:
    """(query, doc, score) of Okapi BM25; a negative idf becomes eps times the average one. Repeated query words count again."""
    own = docs.select(doc, doc_terms.alias("_t")).withColumn("len", F.size("_t"))
    whole = own.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    idf = own.select(F.explode(F.array_distinct("_t")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(whole))  # partial counts: a row a term and task is shuffled
    idf = idf.select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    floor = idf.agg((F.avg("raw") * eps).alias("low"))
    asked = queries.select(query, F.explode(query_terms).alias("term")).groupBy(query, "term").agg(F.count("*").alias("times"))
    wanted = asked.select("term").distinct()
    small = F.broadcast if wanted.count() <= QUERY_TERMS else (lambda df: df)
    idf = idf.join(small(wanted), "term").crossJoin(F.broadcast(floor)).select("term", F.when(F.col("raw") < 0, F.col("low")).otherwise(F.col("raw")).alias("idf"))
    # only postings of the queries' terms are shuffled
    tf = own.select(doc, "len", F.explode("_t").alias("term")).join(small(wanted), "term", "left_semi").groupBy(doc, "len", "term").agg(F.count("*").alias("tf"))
    hit = asked.join(idf, "term").join(tf, "term").crossJoin(F.broadcast(whole))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return hit.groupBy(query, doc).agg(F.sum(part).alias("score"))


def vocabulary_overlap(pairs: DataFrame, left: Column, right: Column, vocabulary: DataFrame, key: str) -> DataFrame:
    """(key, n, ratio, jaccard) of the 1- and 2-grams of two texts that are in the vocabulary; denominators + 1e-6."""
    side = lambda c, name: pairs.select(key, F.explode(F.array_distinct(text.word_ngrams(text.tokens(c), 2))).alias("term")).join(vocabulary, "term", "left_semi").withColumn(name, F.lit(1))
    both = side(left, "_l").join(side(right, "_r"), [key, "term"], "full").groupBy(key).agg(F.sum(F.col("_l") * F.col("_r")).alias("n"), F.sum("_l").alias("a"), F.count("*").alias("u"))
    n, a, u = (F.coalesce(c, F.lit(0)) for c in ("n", "a", "u"))
    return pairs.select(key).join(both, key, "left").select(key, n.cast("long").alias("n"), (n / (a + 1e-6)).alias("ratio"), (n / (u + 1e-6)).alias("jaccard"))
