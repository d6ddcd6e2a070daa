"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import ann, bpe, gif, html_text, licences, mixing, ngram_join, quality, sharding, toxicity
from quarry.llm.common import table, tune


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 8)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return licences.scan(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return bpe.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return gif.store_texts(table(spark, sf_dir, "documents"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100).drop("th", "keep")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_sharding": op2_sharding,
    "op3_quality": op3_quality,
    "op4_licences": op4_licences,
    "op5_bpe": op5_bpe,
    "op6_gif": op6_gif,
    "op7_jaccard": op7_jaccard,
    "op8_mixing": op8_mixing,
    "op9_html": op9_html,
    "op10_ann": op10_ann,
}

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op7_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1) c USING (doc_id)""",
    "op8_mixing": f"""
        WITH d AS (SELECT doc_id, source, CAST(len({WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size, CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
        w AS (SELECT *, 3.0::DOUBLE * source_size AS cap, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS wt FROM s),
        v AS (SELECT *, ((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(wt) FROM w) - coalesce(sum(wt) OVER b, 0)) AS lvl FROM w WINDOW b AS (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, source_size, least(cap, (SELECT max(lvl) FROM v) * wt) AS target FROM v),
        r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS reps FROM t),
        q AS (SELECT d.*, source_size, target, floor(reps) AS whole, (reps - floor(reps)) * source_size AS need, sum(size) OVER (PARTITION BY d.source ORDER BY h % 4096, h, size ROWS UNBOUNDED PRECEDING) - size / 2 AS middle FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE size * (whole + CASE WHEN middle <= need AND need > 0 THEN 1 ELSE 0 END) END AS BIGINT) AS taken FROM q""",
}
