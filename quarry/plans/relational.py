"""Queries: joins, filters, aggregates, windows, set operations, samples, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text
from quarry.functions.similarity import overlap
from quarry.operators import evaluate, relational
from quarry.plans.registry import query, tok
from quarry.sources import io


def documents_of_items(t):
    return t.items.select("item_id", F.concat_ws(" ", *[F.coalesce(F.lower(c), F.lit("")) for c in ("title", "category", "brand", "gender", "age_group", "attributes")]).alias("doc"))


@query(r"""WITH toks AS (SELECT item_id, list_distinct([w FOR w IN string_split_regex(title || ' ' || category || ' ' || brand || ' ' || gender || ' ' || age_group || ' ' || attributes, '[^0-9a-zçğıöşü]+') IF length(w) >= 2]) AS d FROM items),
  qs AS (SELECT term_id, list_distinct([w FOR w IN string_split_regex(query, '[^0-9a-zçğıöşü]+') IF length(w) >= 2]) AS q FROM terms)
  SELECT term_id, item_id, CAST(len(list_intersect(q, d)) AS INT) AS shared, CASE WHEN len(list_intersect(q, d)) >= 1 THEN 1 ELSE 0 END AS prediction
  FROM pairs JOIN qs USING (term_id) JOIN toks USING (item_id)""")
def word_overlap_baseline(t):
    items = documents_of_items(t).select("item_id", F.array_distinct(text.word_tokens(F.col("doc"))).alias("d"))
    terms = t.terms.select("term_id", F.array_distinct(text.word_tokens(F.col("query"))).alias("q"))
    shared = overlap(F.col("q"), F.col("d"))
    terms, items = terms.hint("merge"), items.hint("merge")  # lists of words are many times their files, from whose size Spark would choose to broadcast them
    return t.pairs.join(terms, "term_id").join(items, "item_id").select("term_id", "item_id", shared.alias("shared"), (shared >= 1).cast("int").alias("prediction"))


@query("SELECT term_id, item_id, coalesce(query, 'unknown') AS query, title, category, brand, gender, age_group, attributes FROM pairs LEFT JOIN terms USING (term_id) LEFT JOIN items USING (item_id)")
def pair_term_item_join(t):
    return relational.decorate(t.pairs, t.terms, t.items)


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", adapters=False)
def inner_join_dimensions(t):
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query("SELECT p.item_id, coalesce(b.n, 0) AS n FROM items p LEFT JOIN (SELECT item_id, count(*) AS n FROM scores WHERE label = 1 GROUP BY 1) b USING (item_id)")
def lookup_with_default(t):
    return relational.lookup(t.items.select("item_id"), t.scores.filter("label = 1").groupBy("item_id").agg(F.count("*").alias("n")), "item_id", {"n": 0})


@query("SELECT term_id, item_id FROM scores s WHERE score > 0.5 AND NOT EXISTS (SELECT 1 FROM scores p WHERE p.term_id = s.term_id AND p.item_id = s.item_id AND p.label = 1)")
def anti_join_unseen_pairs(t):
    return relational.unseen(t.scores.filter("score > 0.5").select("term_id", "item_id"), t.scores.filter("label = 1"), "term_id", "item_id")


@query("SELECT item_id, title FROM items WHERE item_id IN (SELECT item_id FROM scores WHERE score > 0.99)")
def semi_join_known_items(t):
    return t.items.select("item_id", "title").join(t.scores.filter("score > 0.99"), "item_id", "left_semi")


@query("SELECT a.term_id, b.term_id AS other, count(*) AS n FROM pairs a JOIN pairs b USING (item_id) WHERE a.term_id <> b.term_id GROUP BY 1, 2 HAVING count(*) >= 3")
def shared_item_terms(t):
    from quarry.operators.retrieve import shared_items

    return shared_items(t.pairs).filter("n >= 3")


@query("SELECT b.brand, count(*) AS n FROM terms JOIN (SELECT DISTINCT brand FROM items WHERE brand <> 'unknown') b ON contains(query, b.brand) GROUP BY 1")
def substring_theta_join(t):
    brands = t.items.select("brand").filter("brand <> 'unknown'").distinct()
    return relational.contained(t.terms, brands, "term_id", "query", "brand").groupBy("brand").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM items WHERE item_id IS NULL) AS null_ids, (SELECT count(DISTINCT term_id) FROM pairs WHERE term_id % 2 = 0 AND term_id IN (SELECT term_id FROM pairs WHERE term_id % 2 = 1)) AS leaked")
def leak_assertion(t):
    odd, even = t.pairs.filter("term_id % 2 = 1").select("term_id"), t.pairs.filter("term_id % 2 = 0").select("term_id").distinct()
    return t.items.agg(F.count_if(F.col("item_id").isNull()).alias("null_ids")).crossJoin(even.join(odd, "term_id", "left_semi").agg(F.count("*").alias("leaked")))  # one row each


@query("""SELECT CASE WHEN contains(query, 'brand') THEN 'brand' WHEN regexp_matches(query, '[0-9]') THEN 'code' WHEN length(query) < 12 THEN 'short' ELSE 'other' END AS kind,
  count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM terms) AS share FROM terms GROUP BY 1""")
def case_rules_share(t):
    q = F.col("query")
    kind = F.when(F.contains(q, F.lit("brand")), "brand").when(q.rlike("[0-9]"), "code").when(F.length(q) < 12, "short").otherwise("other")
    return t.terms.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(t.terms.agg(F.count("*").alias("_t")))).select("kind", "n", (F.col("n") / F.col("_t")).alias("share"))


@query("SELECT count(*) FILTER (score < 0.1) AS sure_no, count(*) FILTER (score > 0.9) AS sure_yes, count(*) FILTER (score >= 0.3 AND score <= 0.7) AS unsure, round(sum(least(greatest(score, 0.2), 0.8)), 6) AS clipped FROM scores")
def score_bands(t):
    s = F.col("score")
    return t.scores.agg(F.count_if(s < 0.1).alias("sure_no"), F.count_if(s > 0.9).alias("sure_yes"), F.count_if((s >= 0.3) & (s <= 0.7)).alias("unsure"), F.round(F.sum(F.least(F.greatest(s, F.lit(0.2)), F.lit(0.8))), 6).alias("clipped"))


@query("SELECT count(*) AS n, count(*) FILTER ((contains(title, 'erkek') AND gender = 'kadın') OR (contains(title, 'kadın') AND gender = 'erkek')) AS mismatched FROM items WHERE length(title) > 10 AND length(attributes) > 3")
def gender_mismatch_filter(t):
    c = F.col
    wrong = (F.contains(c("title"), F.lit("erkek")) & (c("gender") == "kadın")) | (F.contains(c("title"), F.lit("kadın")) & (c("gender") == "erkek"))
    return t.items.filter((F.length("title") > 10) & (F.length("attributes") > 3)).agg(F.count("*").alias("n"), F.count_if(wrong).alias("mismatched"))


# --- aggregates ---------------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc FROM lineitem GROUP BY 1, 2", adapters=False)
def group_aggregate(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", adapters=False)
def value_counts(t):
    from pyspark.sql import Window as W

    g = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 4)).orderBy(F.col("n").desc(), "event_type").limit(20)


@query("SELECT n AS occurrences, count(*) AS n_terms FROM (SELECT term_id, count(*) AS n FROM pairs GROUP BY 1) GROUP BY 1")
def frequency_of_frequency(t):
    return t.pairs.groupBy("term_id").agg(F.count("*").alias("occurrences")).groupBy("occurrences").agg(F.count("*").alias("n_terms"))


@query("SELECT main, count(DISTINCT brand) AS n_brands, count(DISTINCT title) AS n_titles FROM (SELECT string_split(category, '/')[1] AS main, brand, title FROM items) GROUP BY 1")
def distinct_counts(t):
    return t.items.groupBy(F.get(F.split("category", "/"), 0).alias("main")).agg(F.countDistinct("brand").alias("n_brands"), F.countDistinct("title").alias("n_titles"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, median(value) AS med, min(value) AS low, max(value) AS high, round(stddev_samp(value), 6) AS sd,
  round(quantile_cont(CAST(value AS DOUBLE), 0.25), 6) AS q25, round(quantile_cont(CAST(value AS DOUBLE), 0.95), 6) AS q95 FROM events GROUP BY 1""", adapters=False)
def summary_statistics(t):
    v = F.col("value")
    return t.events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.median(v).alias("med"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.stddev_samp(v), 6).alias("sd"),
        F.round(F.percentile(v, 0.25), 6).alias("q25"), F.round(F.percentile(v, 0.95), 6).alias("q95"),
    )


@query("""WITH c AS (SELECT term_id, string_split(category, '/')[1] AS main, count(*) AS n FROM pairs JOIN items USING (item_id) GROUP BY 1, 2)
  SELECT term_id, main, n FROM c QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY n DESC, main) = 1""")
def majority_category(t):
    c = t.pairs.join(t.items.select("item_id", F.get(F.split("category", "/"), 0).alias("main")), "item_id").groupBy("term_id", "main").agg(F.count("*").alias("n"))
    return relational.first_by(c, ["term_id"], F.col("n").desc(), F.col("main"))


@query("SELECT gender, age_group, count(*) AS n FROM items GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20")
def crosstab_top(t):
    return t.items.groupBy("gender", "age_group").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "gender", "age_group").limit(20)


@query("SELECT brand, CAST(sum(label) AS DOUBLE) / count(*) AS mean, count(*) AS n FROM scores JOIN items USING (item_id) GROUP BY 1 HAVING count(*) >= 30")
def mean_having(t):
    return t.scores.join(t.items, "item_id").groupBy("brand").agg(F.avg("label").alias("mean"), F.count("*").alias("n")).filter("n >= 30")


@query("SELECT term_id, list_sort(list(item_id)) AS item_list FROM pairs GROUP BY 1".replace("list_sort(list(item_id)) AS item_list", "array_to_string(list_sort(list(item_id)), ',') AS item_list"))
def grouped_list(t):
    return t.pairs.groupBy("term_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), ",").alias("item_list"))


@query(r"""WITH parts AS (SELECT unnest(string_split(attributes, ',')) AS p FROM items WHERE attributes <> 'unknown'), kv AS (SELECT trim(substring(p, 1, instr(p, ':') - 1)) AS k, trim(substring(p, instr(p, ':') + 1)) AS v FROM parts WHERE contains(p, ':'))
  SELECT k AS key, v AS value, count(*) AS n, sum(count(*)) OVER (PARTITION BY k)::BIGINT AS key_n FROM kv GROUP BY 1, 2""")
def map_key_value_frequency(t):
    from pyspark.sql import Window as W

    from quarry.functions import attrs

    kv = t.items.select(F.explode(attrs.entries(F.col("attributes"))).alias("e")).groupBy(F.col("e.key").alias("key"), F.col("e.value").alias("value")).agg(F.count("*").alias("n"))
    return kv.withColumn("key_n", F.sum("n").over(W.partitionBy("key")))


@query("SELECT * FROM (SELECT 'text' AS \"column\", count(*) FILTER (text IS NULL) AS n_missing, coalesce(CAST(count(*) FILTER (text IS NULL) AS DOUBLE) / count(*), 0) AS share FROM documents UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL), coalesce(CAST(count(*) FILTER (lang IS NULL) AS DOUBLE) / count(*), 0) FROM documents)", adapters=False)
def missing_report(t):
    return evaluate.missing(t.documents.select("text", "lang"))


@query("SELECT CASE WHEN score < 0.4 THEN 'low' WHEN label = 1 THEN 'pos' ELSE 'rest' END AS src, count(*) AS n FROM scores GROUP BY 1")
def source_mix(t):
    return t.scores.groupBy(F.when(F.col("score") < 0.4, "low").when(F.col("label") == 1, "pos").otherwise("rest").alias("src")).agg(F.count("*").alias("n"))


# --- windows ------------------------------------------------------------------------------------------------------------


@query("SELECT term_id, item_id, score, CAST(row_number() OVER w AS INT) AS rank FROM scores WINDOW w AS (PARTITION BY term_id ORDER BY score DESC, item_id) QUALIFY rank <= 14")
def topk_absolute(t):
    return relational.top_k(t.scores, "term_id", 14, F.col("score").desc(), F.col("item_id")).select("term_id", "item_id", "score", "rank")


@query("""WITH k AS (SELECT CAST(round(avg(n)) AS INT) AS k FROM (SELECT term_id, sum(label) AS n FROM scores GROUP BY 1))
  SELECT term_id, item_id, CAST(row_number() OVER w AS INT) AS rank FROM scores WINDOW w AS (PARTITION BY term_id ORDER BY score DESC, item_id) QUALIFY rank <= (SELECT k FROM k)""")
def topk_calibrated(t):
    k = t.scores.groupBy("term_id").agg(F.sum("label").alias("n")).agg(F.round(F.avg("n")).cast("int")).first()[0] or 0
    return relational.top_k(t.scores, "term_id", k, F.col("score").desc(), F.col("item_id")).select("term_id", "item_id", "rank")


@query("""WITH r AS (SELECT term_id, item_id, row_number() OVER (PARTITION BY term_id ORDER BY score DESC, item_id) AS rank, round_even(0.16 * count(*) OVER (PARTITION BY term_id), 0) AS k FROM scores)
  SELECT term_id, item_id, CAST(rank AS INT) AS rank FROM r WHERE rank <= greatest(1, k)""")
def topk_proportional(t):
    return relational.top_share(t.scores, "term_id", 0.16, F.col("score").desc(), F.col("item_id")).select("term_id", "item_id", "rank")


@query("""WITH r AS (SELECT term_id, item_id, score, (rank() OVER (PARTITION BY term_id ORDER BY score) + (count(*) OVER (PARTITION BY term_id, score) - 1) / 2.0) / count(*) OVER p AS pct,
  (score - avg(score) OVER p) / greatest(coalesce(stddev_samp(score) OVER p, 1e-8), 1e-8) AS z, max(score) OVER p AS group_max, score / greatest(max(score) OVER p, 1e-8) AS to_max,
  CASE WHEN max(score) OVER p > min(score) OVER p THEN (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) ELSE 0.0 END AS minmax FROM scores WINDOW p AS (PARTITION BY term_id))
  SELECT term_id, item_id, round(CAST(pct AS DOUBLE), 9) AS pct, round(z, 6) AS z, group_max, round(to_max, 9) AS to_max, round(minmax, 9) AS minmax FROM r""")
def group_score_statistics(t):
    g = relational.group_statistics(t.scores, "term_id", "score")
    return g.select("term_id", "item_id", F.round("pct", 9).alias("pct"), F.round("z", 6).alias("z"), "group_max", F.round("to_max", 9).alias("to_max"), F.round("minmax", 9).alias("minmax"))


@query("SELECT term_id, item_id, CAST(row_number() OVER w AS INT) AS rank FROM scores WINDOW w AS (PARTITION BY term_id ORDER BY score DESC, item_id) QUALIFY rank BETWEEN 11 AND 60")
def rank_range(t):
    return relational.rank_band(t.scores, "term_id", 11, 60, F.col("score").desc(), F.col("item_id")).select("term_id", "item_id", "rank")


@query("""WITH a AS (SELECT term_id, item_id, score FROM scores QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY score DESC, item_id) <= 30)
  SELECT term_id, item_id, score, CAST(row_number() OVER (PARTITION BY term_id ORDER BY score DESC, item_id) AS INT) AS rank FROM a WHERE NOT EXISTS (SELECT 1 FROM scores k WHERE k.term_id = a.term_id AND k.item_id = a.item_id AND k.label = 1) QUALIFY rank <= 5""")
def first_n_after_exclusion(t):
    known = t.scores.filter("label = 1").select("term_id", "item_id")
    return relational.after_exclusion(t.scores.drop("label"), known, "term_id", ["term_id", "item_id"], 30, 5, F.col("score").desc(), F.col("item_id"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1", adapters=False)
def first_wins(t):
    return relational.first_by(t.conversations.select("conv_id", "turn", "role"), ["conv_id", "role"], F.col("turn"))


@query("""WITH p AS (SELECT string_split(category, '/')[1] AS main, item_id, row_number() OVER (PARTITION BY string_split(category, '/')[1] ORDER BY item_id) - 1 AS slot FROM items),
  k AS (SELECT string_split(category, '/')[1] AS main, term_id, row_number() OVER (PARTITION BY string_split(category, '/')[1] ORDER BY term_id, i.item_id) - 1 AS taker FROM pairs JOIN items i USING (item_id))
  SELECT main, term_id, item_id FROM p JOIN k USING (main) WHERE slot // 2 = taker""".replace("i.item_id", "item_id"))
def pool_consumption(t):
    main = F.get(F.split("category", "/"), 0).alias("main")
    pool = t.items.select(main, "item_id")
    takers = t.pairs.join(t.items.select("item_id", main), "item_id").select("main", "term_id", F.col("item_id").alias("_i"))
    return relational.consume(pool, takers, "main", 2, [F.col("item_id")], [F.col("term_id"), F.col("_i")]).select("main", "term_id", "item_id")


@query(rf"WITH t AS (SELECT term_id, {tok('query')} AS ws FROM terms) SELECT g, count(*) AS n FROM (SELECT unnest([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) AS g FROM t) GROUP BY 1")
def adjacent_bigrams(t):
    return t.terms.select(F.explode(text.bigrams(text.tokens(F.col("query")))).alias("g")).groupBy("g").agg(F.count("*").alias("n"))


# --- samples ------------------------------------------------------------------------------------------------------------

DRAW = "CAST('0x' || substr(md5('42|' || CAST({k} AS VARCHAR)), 1, 8) AS BIGINT)"


@query(f"SELECT term_id, query FROM terms ORDER BY {DRAW.format(k='term_id')}, term_id LIMIT 50")
def uniform_sample(t):
    return relational.sample(t.terms, 50, 42, "term_id")


@query(f"SELECT term_id, item_id FROM pairs WHERE term_id IN (SELECT term_id FROM (SELECT DISTINCT term_id FROM pairs) ORDER BY {DRAW.format(k='term_id')}, term_id LIMIT 30)")
def sample_of_groups(t):
    return relational.sample_groups(t.pairs, "term_id", 30, 42)


@query(f"""WITH a AS (SELECT term_id, 'short' AS stratum FROM terms WHERE length(query) < 12 ORDER BY {DRAW.format(k='term_id')}, term_id LIMIT 40),
  b AS (SELECT term_id, 'brand' AS stratum FROM terms WHERE contains(query, 'brand') AND term_id NOT IN (SELECT term_id FROM a) ORDER BY {DRAW.format(k='term_id')}, term_id LIMIT 40),
  c AS (SELECT term_id, 'random' AS stratum FROM terms WHERE term_id NOT IN (SELECT term_id FROM a UNION SELECT term_id FROM b) ORDER BY {DRAW.format(k='term_id')}, term_id LIMIT 20)
  SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def stratified_sample(t):
    q = F.col("query")
    return relational.stratified(t.terms, [("short", F.length(q) < 12, 40), ("brand", F.contains(q, F.lit("brand")), 40), ("random", F.lit(True), 20)], 42, "term_id").select("term_id", "stratum")


@query(f"SELECT term_id FROM terms WHERE contains(query, '500 ml') UNION ALL (SELECT term_id FROM terms WHERE NOT contains(query, '500 ml') ORDER BY {DRAW.format(k='term_id')}, term_id LIMIT greatest(0, 400 - (SELECT count(*) FROM terms WHERE contains(query, '500 ml'))))")
def rare_sources_and_fill(t):
    return relational.rare_and_fill(t.terms, F.contains(F.col("query"), F.lit("500 ml")), 400, 42, "term_id").select("term_id")


# --- set operations -----------------------------------------------------------------------------------------------------


@query("SELECT term_id, item_id, CASE WHEN label = 1 THEN 'a' WHEN score > 0.5 THEN 'b' ELSE 'c' END AS src FROM scores")
def priority_union_dedup(t):
    part = lambda condition, s: t.scores.filter(condition).select("term_id", "item_id", F.lit(s).alias("src"))
    return relational.union_by_priority([part("label = 1", "a"), part("score > 0.5", "b"), part("true", "c")], ["term_id", "item_id"])


@query("""SELECT (SELECT count(*) FROM (SELECT item_id FROM scores WHERE label = 1 INTERSECT SELECT item_id FROM scores WHERE label = 0)) AS both_sides,
  (SELECT count(*) FROM (SELECT item_id FROM scores WHERE score > 0.9 EXCEPT SELECT item_id FROM scores WHERE score < 0.1)) AS one_side, (SELECT count(*) FROM (SELECT DISTINCT brand, gender FROM items)) AS n_distinct""")
def key_set_operations(t):
    ids = lambda condition: t.scores.filter(condition).select("item_id")
    a = ids("label = 1").intersect(ids("label = 0")).agg(F.count("*").alias("both_sides"))
    b = ids("score > 0.9").subtract(ids("score < 0.1")).agg(F.count("*").alias("one_side"))
    return a.crossJoin(b).crossJoin(t.items.select("brand", "gender").distinct().agg(F.count("*").alias("n_distinct")))  # one row each


# --- sinks --------------------------------------------------------------------------------------------------------------


@query("SELECT t.term_id AS id, coalesce(s.prediction, 0) AS prediction FROM terms t LEFT JOIN (SELECT term_id, 1 AS prediction FROM terms WHERE contains(query, 'red')) s USING (term_id)")
def sample_conformant_sink(t):
    sample = t.terms.select(F.col("term_id").alias("id"))
    return io.conform(sample, t.terms.filter(F.contains("query", F.lit("red"))).select(F.col("term_id").alias("id"), F.lit(1).alias("prediction")))


@query("SELECT term_id % 10 AS batch FROM (SELECT DISTINCT term_id FROM pairs) GROUP BY 1 HAVING term_id % 10 IN (3, 7)")
def missing_partitions(t):
    batches = t.pairs.select((F.col("term_id") % 10).alias("batch"))
    return io.missing_batches(batches, batches.filter("batch NOT IN (3, 7)"))


@query("""WITH l AS (SELECT term_id % 20 AS version, 'old' AS notes, 0 AS fresh FROM terms UNION SELECT term_id % 10, 'new', 1 FROM terms) SELECT version, notes FROM l QUALIFY row_number() OVER (PARTITION BY version ORDER BY fresh DESC) = 1""")
def run_log_upsert(t):
    log = t.terms.select((F.col("term_id") % 20).alias("version")).distinct().withColumn("notes", F.lit("old"))
    return io.upsert(log, t.terms.select((F.col("term_id") % 10).alias("version")).distinct().withColumn("notes", F.lit("new")))


@query("SELECT '{\"n\":' || count(*) || ',\"positives\":' || sum(label) || '}' AS metrics FROM scores")
def metrics_json(t):
    return t.scores.agg(F.count("*").alias("n"), F.sum("label").alias("positives")).select(io.as_json(F.col("n"), F.col("positives")).alias("metrics"))
