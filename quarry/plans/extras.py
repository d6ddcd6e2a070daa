"""Queries: whole feature frames, further negatives, mined and pseudo labels, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import attrs, similarity, text
from quarry.functions import lexicon as L
from quarry.operators import dictionary, evaluate, features, model, nearest, negatives, parse, relational
from quarry.plans.models import DECORATED, TOP, TREE_FEATURES, decorated, source_sql, top, training
from quarry.plans.registry import query, quoted, tok
from quarry.plans.text_features import BRANDS, FOLD, KV, PAIR, QW, TFIDF, TYPED, BT, STEM, nearest_titles, per_pair, stems_sql

c = F.col


@query()
def pair_feature_frame(t):
    return features.pair_features(t.pairs, t.terms, t.items, t.scores.drop("label"))


@query()
def labeler_feature_frame(t):
    return features.labeler_features(t.pairs, t.terms, t.items, t.scores.drop("label"))


@query(f"""WITH {PAIR}, a AS (SELECT term_id, item_id, regexp_extract_all({FOLD.format('query')}, '[a-z0-9]+') AS fq, regexp_extract_all({FOLD.format('title')}, '[a-z0-9]+') AS ft, {FOLD.format('age_group')} AS ag FROM pp),
  b AS (SELECT *, list_contains(fq, 'bebek') AS qb, list_contains(fq, 'cocuk') AS qc, list_contains(fq, 'yetiskin') AS qa, ag = 'bebek' OR list_contains(ft, 'bebek') AS ib, ag IN ('cocuk', 'bebek & cocuk', 'genc') OR list_contains(ft, 'cocuk') AS ic, ag = 'yetiskin' OR list_contains(ft, 'yetiskin') AS ia FROM a)
  SELECT term_id, item_id, CAST(CASE WHEN (qb AND ib) OR (qc AND ic) OR (qa AND ia) THEN 1 WHEN (qb AND ia) OR (qc AND ia) OR (qa AND (ib OR ic)) THEN -1 ELSE 0 END AS DOUBLE) AS age_signal FROM b""")
def folded_age_signal(t):
    from quarry.functions import signals

    return per_pair(t).select("term_id", "item_id", signals.folded_age(c("query"), c("age_group"), c("title")).alias("age_signal"))


@query(f"""WITH {KV}, o AS (SELECT item_id, k, min(i) AS first, arg_max(v, i) AS v FROM (SELECT item_id, unnest([x.k FOR x IN e]) AS k, unnest([x.v FOR x IN e]) AS v, unnest(range(len(e))) AS i FROM kv) GROUP BY 1, 2),
  r AS (SELECT item_id, k || ':' || v AS s, row_number() OVER (PARTITION BY item_id ORDER BY first) AS n FROM o) SELECT item_id, coalesce(short, '') AS short FROM items LEFT JOIN (SELECT item_id, string_agg(s, '; ' ORDER BY n) AS short FROM r WHERE n <= 4 GROUP BY 1) USING (item_id)""")
def attribute_short_text(t):
    return t.items.select("item_id", attrs.short_text(c("attributes")).alias("short"))


@query(f"""WITH {PAIR}, {KV}, v AS (SELECT item_id, coalesce([x.v FOR x IN e IF x.k = 'renk'][-1], '') AS renk FROM kv), a AS (SELECT term_id, item_id, [w FOR w IN q IF w IN ({quoted(L.COLOURS)})] AS qc, [w FOR w IN tt IF w IN ({quoted(L.COLOURS)})] AS tc, renk, title FROM pp JOIN v USING (item_id))
  SELECT term_id, item_id, CAST(len(list_intersect(qc, tc)) > 0 AS DOUBLE) AS renk_q_in_t, CAST(len(qc) > 0 AND len(tc) = 0 AS DOUBLE) AS renk_mismatch, CAST(renk <> '' AND contains(title, renk) AS DOUBLE) AS attr_renk_in_title FROM a""")
def colour_flags(t):
    of = lambda x: F.filter(c(x), lambda w: w.isin(*L.COLOURS))
    colour = attrs.value_of(c("attributes"), "renk")
    return per_pair(t).select(
        "term_id", "item_id", F.arrays_overlap(of("q"), of("tt")).cast("double").alias("renk_q_in_t"), ((F.size(of("q")) > 0) & (F.size(of("tt")) == 0)).cast("double").alias("renk_mismatch"),
        ((colour != "") & F.contains(c("title"), colour)).cast("double").alias("attr_renk_in_title"),
    )


@query(f"""WITH {PAIR}, bt0 AS (SELECT item_id, unnest({BT}) AS b FROM items), bf AS (SELECT b FROM bt0 GROUP BY 1 HAVING count(*) >= 3), qx AS (SELECT term_id, unnest(q) AS w FROM qt), qn AS (SELECT term_id, CAST(count(*) FILTER (w IN (SELECT b FROM bf)) AS DOUBLE) / count(*) AS brand_weight FROM qx GROUP BY 1),
  d AS (SELECT *, [w FOR w IN q IF w NOT IN ({TYPED}) AND length(w) > 1 AND NOT list_contains({BT}, w)] AS kw, {stems_sql('tt')} AS ts FROM pp), x AS (SELECT term_id, item_id, unnest(kw) AS w, len(kw) AS n, tt, ts FROM d),
  m AS (SELECT term_id, item_id, CAST(count(*) FILTER (list_contains(tt, w) OR list_contains(ts, {STEM.format('w')}) OR (length({STEM.format('w')}) >= 5 AND len([y FOR y IN tt IF starts_with(y, substr({STEM.format('w')}, 1, 5))]) > 0)) AS DOUBLE) / max(n) AS pc FROM x GROUP BY 1, 2)
  SELECT term_id, item_id, round(brand_weight, 9) AS brand_weight, round(coalesce(pc, 0.0), 9) AS product_type_cover FROM d JOIN qn USING (term_id) LEFT JOIN m USING (term_id, item_id)""")
def brand_and_product_variants(t):
    frequent = t.items.select(F.explode(similarity.brand_tokens(c("brand"))).alias("w")).groupBy("w").count().filter("count >= 3").select("w", F.lit(1.0).alias("hit"))
    words = t.terms.select("term_id", F.explode(text.tokens(c("query"))).alias("w")).join(frequent, "w", "left")
    weight = words.groupBy("term_id").agg((F.sum(F.coalesce("hit", F.lit(0.0))) / F.count("*")).alias("brand_weight"))
    return per_pair(t).join(weight, "term_id").select("term_id", "item_id", F.round("brand_weight", 9).alias("brand_weight"), F.round(similarity.product_words_cover(c("q"), c("tt"), c("brand"), word_stems=c("st"), product=c("product"), brand_words=c("bt")), 9).alias("product_type_cover"))


CHARS = "unnest(list_concat([x[i:i + 2] FOR i IN range(1, greatest(length(x) - 2, 1) + 1)], list_concat(CASE WHEN length(x) > 3 THEN [x[i:i + 3] FOR i IN range(1, greatest(length(x) - 3, 1) + 1)] ELSE [] END, CASE WHEN length(x) > 4 THEN [x[i:i + 4] FOR i IN range(1, greatest(length(x) - 4, 1) + 1)] ELSE [] END)))"


@query(f"""WITH cw AS (SELECT term_id, ' ' || unnest({tok('query')}) || ' ' AS x FROM terms), cg AS (SELECT term_id, {CHARS} AS term FROM cw), tf AS (SELECT term_id, term, count(*) AS tf FROM cg GROUP BY 1, 2), dfx AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2),
  w0 AS (SELECT term_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM terms)) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM tf JOIN dfx USING (term)), w1 AS (SELECT term_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY term_id)) AS w FROM w0),
  s AS (SELECT a.term_id, b.term_id AS other, round(sum(a.w * b.w), 6) AS score FROM w1 a JOIN w1 b ON a.term = b.term WHERE a.term_id <> b.term_id GROUP BY 1, 2) SELECT term_id, other, score, CAST(row_number() OVER (PARTITION BY term_id ORDER BY score DESC, other) AS INT) AS rank FROM s WHERE score >= 0.05 QUALIFY rank <= 10""")
def char_tfidf_neighbours(t):
    grams = text.char_ngrams(text.tokens(c("query")))
    near = nearest.lists(t.terms, t.terms.withColumnRenamed("term_id", "other"), "term_id", "other", grams, grams, 11)  # itself may be one of them
    return nearest.ranked(near.withColumn("near", F.filter("near", lambda x: (x["other"] != c("term_id")) & (x["score"] >= 0.05))), 10)


@query(f"WITH {TOP} SELECT query_id, item_id, round(score, 6) AS score FROM r WHERE rank <= 50 AND score >= 0.3", adapters=False)
def knn_neighbours(t):
    return top(t, 50).filter("score >= 0.3").select("query_id", "item_id", F.round("score", 6).alias("score"))


# --- negatives, pseudo labels, expansion --------------------------------------------------------------------------------


@query("""WITH ii AS (SELECT item_id, string_split(category, '/')[1] AS main FROM items), po AS (SELECT item_id AS neg, main, row_number() OVER (PARTITION BY main ORDER BY substr(md5(CAST(item_id AS VARCHAR)), 1, 2), item_id) - 1 AS position, count(*) OVER (PARTITION BY main) AS pool_size FROM ii), z AS (SELECT DISTINCT main, pool_size FROM po),
  x AS (SELECT term_id, main, copy, CAST('0x' || substr(md5('42|replace|' || term_id || '|' || item_id || '|' || copy), 1, 8) AS BIGINT) % pool_size AS position FROM pairs JOIN ii USING (item_id) JOIN z USING (main), range(0, 2) g(copy))
  SELECT x.term_id, neg AS item_id, CAST(copy AS INT) AS copy FROM x JOIN po USING (main, position) WHERE NOT EXISTS (SELECT 1 FROM pairs k WHERE k.term_id = x.term_id AND k.item_id = neg)""")
def category_draws_with_replacement(t):
    p, i = decorated(t)
    return negatives.with_replacement(p, i, "main", 2, 42)


@query(f"""WITH {DECORATED}, d1 AS (SELECT * FROM dp QUALIFY row_number() OVER (PARTITION BY term_id, main ORDER BY item_id) = 1), {source_sql('per_term', pool='main', key='d.main', tries=20, most=5, of='d1')} SELECT term_id, item_id FROM per_term_f""")
def category_negatives_per_term(t):
    p, i = decorated(t)
    once = relational.first_by(p, ["term_id", "main"], c("item_id"))
    source = negatives.Source("per_term", {"main": c("main")}, tries=20, most=5)
    return negatives.drawn(once, i, [source], 42, t.pairs).select("term_id", "item_id")


REPLACE = "CAST('0x' || substr(md5('42|{0}|' || term_id || '|' || item_id || '|' || copy), 1, 8) AS BIGINT)"
PLACE = "substr(md5(CAST(item_id AS VARCHAR)), 1, 2), item_id"


@query(f"""WITH ii AS (SELECT item_id, string_split(category, '/')[1] AS main FROM items), po AS (SELECT item_id AS neg, main, row_number() OVER (PARTITION BY main ORDER BY {PLACE}) - 1 AS position, count(*) OVER (PARTITION BY main) AS n, row_number() OVER (ORDER BY {PLACE}) - 1 AS place, count(*) OVER () AS m FROM ii),
  z AS (SELECT DISTINCT main, n FROM po), x AS (SELECT term_id, item_id, main, copy FROM pairs JOIN ii USING (item_id), range(0, 2) g(copy)),
  r AS (SELECT term_id, neg, 'hard' AS part FROM (SELECT term_id, x.main, {REPLACE.format('replace')} % n AS position FROM x JOIN z USING (main)) JOIN po USING (main, position) UNION ALL SELECT term_id, neg, 'easy' FROM (SELECT term_id, {REPLACE.format('easy')} % (SELECT max(m) FROM po) AS place FROM x) JOIN po USING (place))
  SELECT term_id, neg AS item_id, part FROM r WHERE NOT EXISTS (SELECT 1 FROM pairs k WHERE k.term_id = r.term_id AND k.item_id = neg)""")
def half_random_negatives(t):
    p, i = decorated(t)
    return negatives.halves(p, i, "main", 2, 2, 42)


@query(f"WITH {TFIDF}, s AS (SELECT term_id, item_id, round(sum(qw.w * iw.w), 6) AS score FROM qw JOIN iw USING (term) GROUP BY 1, 2 HAVING round(sum(qw.w * iw.w), 6) > 0.01), a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY score DESC, item_id) <= 60) SELECT term_id, item_id, score, CAST(row_number() OVER (PARTITION BY term_id ORDER BY score DESC, item_id) AS INT) AS rank FROM a WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.term_id = a.term_id AND p.item_id = a.item_id) QUALIFY rank <= 20")
def tfidf_mined_negatives(t):
    return negatives.mined_from_lists(nearest_titles(t.terms, t, 60, nearest.lists), t.pairs, 60, 20, 0.01)


@query(f"WITH {PAIR} SELECT term_id, item_id FROM pp WHERE (contains(query, 'erkek') AND gender = 'kadın') OR (contains(query, 'kadın') AND gender = 'erkek') OR len(list_intersect(q, list_concat(tt, ct))) = 0")
def leaky_pool_filter(t):
    return negatives.pool_filter(t.pairs.join(t.terms, "term_id").join(t.items, "item_id"), leaky=True).select("term_id", "item_id")


@query(f"WITH {PAIR} SELECT q[1] || ' ' || q[2] AS query, item_id, count(*) AS n FROM pp WHERE len(q) >= 3 GROUP BY 1, 2")
def prefix_expansion(t):
    return negatives.expanded(t.pairs.join(t.terms, "term_id")).groupBy("query", "item_id").agg(F.count("*").alias("n"))


@query(f"WITH {PAIR}, w AS (SELECT term_id, item_id, title || ' ' || brand AS x, {QW} AS ws FROM pp) SELECT term_id, item_id FROM w WHERE len(ws) > 0 AND len([z FOR z IN ws IF NOT contains(x, z)]) = 0")
def containment_positives(t):
    return negatives.contained(t.pairs.join(t.terms, "term_id").join(t.items, "item_id"), dictionary.query_words(c("query"))).select("term_id", "item_id")


ORDER = "CAST('0x' || substr(md5('42|' || term_id || '|' || item_id), 1, 8) AS BIGINT), term_id, item_id"


@query(f"SELECT * FROM (SELECT term_id, item_id, 0 AS label FROM scores WHERE score < 0.1 ORDER BY {ORDER} LIMIT 300) UNION ALL SELECT * FROM (SELECT term_id, item_id, 1 AS label FROM scores WHERE score > 0.9 ORDER BY {ORDER} LIMIT 100)")
def pseudo_labels(t):
    return negatives.pseudo_labels(t.scores, 0.1, 0.9, {0: 300, 1: 100}, 42)


# --- validation and reports ---------------------------------------------------------------------------------------------


@query(f"""WITH {BRANDS}, hx AS (SELECT term_id, unnest({tok('query')}) AS token, unnest(range(len({tok('query')}))) AS i FROM terms), hb AS (SELECT term_id, brand AS found FROM hx JOIN bd USING (token) QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY confidence DESC, i) = 1)
  SELECT CASE WHEN found IS NULL THEN 'no_brand' WHEN t.term_id IS NOT NULL THEN 'right' ELSE 'wrong' END AS outcome, count(*) AS n FROM (SELECT DISTINCT term_id FROM pairs JOIN terms USING (term_id)) p LEFT JOIN hb USING (term_id) LEFT JOIN tbr t ON t.term_id = p.term_id AND t.brand = found GROUP BY 1""")
def parser_validation(t):
    parsed = parse.parse(t.terms, dictionary.brand_dictionary(t.pairs, t.terms, t.items)).select("term_id", c("brand").alias("found"))
    own = t.pairs.join(t.items.select("item_id", F.try_element_at(text.tokens(c("brand")), F.lit(1)).alias("found")), "item_id").select("term_id", "found").distinct().withColumn("_hit", F.lit(1))
    j = parsed.join(t.pairs.select("term_id").distinct(), "term_id").join(own, ["term_id", "found"], "left")
    return j.groupBy(F.when(c("found").isNull(), "no_brand").when(c("_hit") == 1, "right").otherwise("wrong").alias("outcome")).agg(F.count("*").alias("n"))


AUC = """SELECT '{0}' AS feature, round(CAST(greatest(raw, 1 - raw) AS DOUBLE), 9) AS auc, raw < 0.5 AS flipped FROM (SELECT (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label = 0)) AS raw
  FROM (SELECT label, rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0 AS rk FROM tr))"""
JAC = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 0.0::DOUBLE ELSE CAST(len(list_intersect({0}, {1})) AS DOUBLE) / len(list_distinct(list_concat({0}, {1}))) END"
COV = "CASE WHEN len({0}) = 0 THEN 0.0::DOUBLE ELSE CAST(len(list_intersect({0}, {1})) AS DOUBLE) / len(list_distinct({0})) END"
RANKED = ["jaccard", "q_cov_title", "t_cov_query", "cat_overlap", "clue"]


@query(f"""WITH {PAIR}, tr AS (SELECT CASE WHEN (term_id + item_id) % 3 = 0 THEN 1 ELSE 0 END AS label, {JAC.format('q', 'tt')} AS jaccard, {COV.format('q', 'tt')} AS q_cov_title, {COV.format('tt', 'q')} AS t_cov_query, {JAC.format('q', 'ct')} AS cat_overlap, CAST((term_id + item_id) % 3 + (item_id % 7) * CAST(0.18 AS DOUBLE) AS DOUBLE) AS clue FROM pp) {' UNION ALL '.join(AUC.format(f) for f in RANKED)}""")
def feature_auc_table(t):
    d = training(t)
    out = None
    for f in RANKED:
        part = evaluate.auc(d, "label", f).select(F.lit(f).alias("feature"), F.round("auc", 9).alias("auc"), "flipped")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def feature_importance(t):
    """Mean importances over the models of five folds, with the operator's own settings."""
    _, models = model.oof_scores(training(t), TREE_FEATURES, "label", "term_id")
    return t.spark.createDataFrame([(n, float(v)) for n, v in model.importances(models, TREE_FEATURES)], "feature string, importance double")
