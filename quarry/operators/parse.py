"""Query parsing into brand, demographics, colours, sizes, materials and what is left of the product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import lexicon as L
from quarry.functions import text
from quarry.operators.dictionary import product_vocabulary


def sizes(query: Column) -> Column:
    """``{number}{unit}`` of each unit in turn, then shoe numbers, then garment sizes."""
    edge = r"(?=$|[^0-9a-zçğıöşü])"
    with_unit = lambda numbers, unit: F.transform(numbers, lambda x: F.concat(x, F.lit(unit)))
    found = [with_unit(F.regexp_extract_all(query, F.lit(rf"(?<![0-9a-zçğıöşü])(\d+(?:\.\d+)?)\s*{word}{edge}"), F.lit(1)), unit) for word, unit in L.UNITS]
    found.append(with_unit(F.regexp_extract_all(query, F.lit(rf"(?<![0-9a-zçğıöşü])(\d+)\s*numara{edge}"), F.lit(1)), "numara"))
    found.append(with_unit(F.regexp_extract_all(query, F.lit(rf"(?<![0-9a-zçğıöşü])no[\s.]?(\d+){edge}"), F.lit(1)), "numara"))
    found.append(with_unit(F.regexp_extract_all(query, F.lit(rf"(?<![0-9a-zçğıöşü])({'|'.join(L.GARMENT_SIZES)}){edge}"), F.lit(1)), "tekstil_beden"))
    return F.flatten(F.array(*found))


def parse(terms: DataFrame, brands: DataFrame) -> DataFrame:
    """One row a term: normalized, brand, brand_conf, gender, age_range, colors, sizes, materials (joined by |), product_tokens.

    The brand is that of the most certain word of ``brands`` (token, brand, confidence), the first one on ties; of gender
    and age words the last one counts.
    """
    own = terms.select("term_id", "query", text.lower_tr(F.coalesce("query", F.lit(""))).alias("normalized")).withColumn("t", text.tokens(F.col("normalized")))
    hits = own.select("term_id", F.posexplode("t").alias("i", "token")).join(brands.select("token", "brand", "confidence"), "token")
    best = hits.groupBy("term_id").agg(F.max_by(F.struct("token", "brand", "confidence"), F.struct("confidence", -F.col("i"))).alias("b"))
    last = lambda table: F.try_element_at(F.filter(F.transform("t", lambda w: text.lookup(w, table)), lambda v: v.isNotNull()), F.lit(-1))
    joined = own.join(best, "term_id", "left")
    skip = [*L.PARSE_COLOURS, *L.PARSE_MATERIALS, *L.PARSE_GENDER, *L.PARSE_AGE, *L.STOP_QUERY]
    product = F.filter(text.without(F.col("t"), skip), lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]") & (F.col("b.token").isNull() | (w != F.col("b.token"))))
    of = lambda words: F.array_join(F.filter("t", lambda w: w.isin(*words)), "|")
    return joined.select(
        "term_id", "query", "normalized", F.col("b.brand").alias("brand"), F.coalesce(F.round("b.confidence", 3), F.lit(0.0)).alias("brand_conf"),
        last(L.PARSE_GENDER).alias("gender"), last(L.PARSE_AGE).alias("age_range"), of(L.PARSE_COLOURS).alias("colors"),
        F.array_join(sizes(F.col("normalized")), "|").alias("sizes"), of(L.PARSE_MATERIALS).alias("materials"), F.array_join(product, " ").alias("product_tokens"),
    )


def brand_span(terms: DataFrame, items: DataFrame, frequent: int = 5, most: int = 5) -> DataFrame:
    """term_id, brand_found, brand_pos, brand_len, method and product_part (the query without the span).

    The longest span that is a brand, the first one on ties; else the first word that occurs in ``frequent`` brands.
    """
    brands = items.select("brand").distinct().filter(~F.col("brand").isin("", L.UNKNOWN))
    common = brands.select(F.explode(text.tokens(F.col("brand"))).alias("g")).filter(F.length("g") >= 4).groupBy("g").count().filter(F.col("count") >= frequent).select("g")
    own = terms.select("term_id", text.tokens(F.col("query")).alias("t"))
    spans = own.select("term_id", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(F.size("t") - n, F.lit(0))), lambda s: s + n <= F.size("t")),
        lambda s: F.struct(n.alias("n"), s.alias("s"), F.array_join(F.slice(F.col("t"), s + 1, n), " ").alias("g")))))).alias("x")).select("term_id", "x.*")
    exact = spans.join(brands.select(F.col("brand").alias("g")), "g").withColumn("method", F.lit("exact"))
    token = spans.filter("n = 1").join(common, "g").withColumn("method", F.lit("token"))
    both = exact.unionByName(token).withColumn("_r", F.row_number().over(W.partitionBy("term_id").orderBy("method", F.col("n").desc(), "s"))).filter("_r = 1")
    out = own.join(both, "term_id", "left")
    rest = F.filter("t", lambda w, i: F.col("s").isNull() | (i < F.col("s")) | (i >= F.col("s") + F.col("n")))
    return out.select(
        "term_id", F.col("g").alias("brand_found"), F.col("s").alias("brand_pos"), F.coalesce("n", F.lit(0)).alias("brand_len"),
        F.coalesce("method", F.lit("none")).alias("method"), F.array_join(rest, " ").alias("product_part"),
    )


def demographics(query: Column) -> tuple[Column, Column]:
    """(gender, age); words for boys and girls come first, and 'none' is null."""
    has = lambda *w: query.rlike(L.whole_word(*w))
    gender = (
        F.when(F.contains(query, F.lit("erkek çocuk")) | F.contains(query, F.lit("erkekçocuk")), "erkek_çocuk")
        .when(F.contains(query, F.lit("kız çocuk")) | F.contains(query, F.lit("kızçocuk")), "kız_çocuk")
        .when(has("kadın", "bayan"), "kadın").when(has("kız"), "kız_çocuk").when(has("erkek"), "erkek").when(has("unisex"), "unisex")
    )
    age = F.when(has("bebek", "infant"), "bebek").when(has("çocuk", "kids", "junior"), "çocuk").when(has("genç"), "genç").when(has("yetişkin"), "yetişkin")
    return gender, age


def specificity(parts: DataFrame, items: DataFrame, least: int = 50) -> DataFrame:
    """term_id, n_matched, specificity of product_part: soyut (empty), belirsiz (0 words of the vocabulary), kategori (1), spesifik."""
    vocabulary = product_vocabulary(items, least)
    known = vocabulary.select("word").unionAll(vocabulary.select(text.stem(F.col("word")))).distinct()
    stems = vocabulary.select(text.stem(F.col("word")).alias("stem")).distinct()
    words = parts.select("term_id", F.posexplode(text.tokens(F.col("product_part"))).alias("i", "word"))
    hits = words.join(vocabulary.select("word"), "word", "left_semi").unionByName(words.withColumn("stem", text.stem(F.col("word"))).join(stems, "stem", "left_semi").drop("stem")).distinct()
    del known
    n = hits.groupBy("term_id").agg(F.count("*").alias("n_matched"))
    out = parts.join(n, "term_id", "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))
    kind = F.when(F.col("product_part") == "", "soyut").when(F.col("n_matched") == 0, "belirsiz").when(F.col("n_matched") == 1, "kategori").otherwise("spesifik")
    return out.select("term_id", "n_matched", kind.alias("specificity"))


def attribute_lists(query: Column) -> list[Column]:
    """Sorted distinct colour, size, material and style words of a query."""
    t = text.tokens(query)
    of = lambda words, name: F.array_join(F.array_sort(F.array_distinct(F.filter(t, lambda w: w.isin(*words)))), "|").alias(name)
    return [of(L.LIST_COLOURS, "attr_colour"), of(L.LIST_SIZES, "attr_size"), of(L.LIST_MATERIALS, "attr_material"), of(L.LIST_STYLES, "attr_style")]


def composite_type(method: Column, gender: Column, age: Column, colour: Column, size: Column, kind: Column) -> Column:
    """``MARKA + CİNS(x) + YAŞ(y) + RENK + BEDEN + ÜRÜN``, only what is there; BELİRSİZ without anything."""
    label = F.concat_ws(
        " + ", F.when(method != "none", "MARKA"), F.concat(F.lit("CİNS("), gender, F.lit(")")), F.concat(F.lit("YAŞ("), age, F.lit(")")), F.when(colour != "", "RENK"),
        F.when(size != "", "BEDEN"), F.when(kind == "spesifik", "ÜRÜN↑").when(kind == "kategori", "ÜRÜN"),
    )
    return F.when(label == "", "BELİRSİZ").otherwise(label)
