"""Queries: dense retrieval, candidates, labels, negatives, scorers, evaluation, thresholds, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import attrs, signals
from quarry.operators import evaluate, model, negatives, relational, retrieve
from quarry.plans.registry import query
from quarry.plans.text_features import FAMILY, KV, SYN, has, word
from quarry.functions import lexicon as L
from quarry.plans.registry import quoted, tok
from quarry.sources import io

c = F.col
DOT = "list_reduce(list_prepend(CAST(0 AS DOUBLE), [CAST({0}[z] AS DOUBLE) * CAST({1}[z] AS DOUBLE) FOR z IN range(1, len({0}) + 1)]), lambda s, x: s + x)"


def vectors(t):
    return t.embeddings.select(c("vec_id"), c("embedding").alias("vec"), "label")


@query("SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(coalesce(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 6) AS cosine FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 7", adapters=False)
def embedding_pair_cosine(t):
    v = vectors(t)
    pairs = v.select(c("vec_id").alias("left_id"), (c("vec_id") + 7).alias("_r"))
    got = retrieve.pair_cosine(pairs, v.select(c("vec_id").alias("left_id"), "vec"), v.select(c("vec_id").alias("_r"), "vec"), "left_id", "_r")
    known = v.select(c("vec_id").alias("_r"), c("vec_id").alias("right_id"))
    return got.join(known, "_r", "left").select("left_id", "right_id", F.round("cosine", 6).alias("cosine"))


TOP = "s AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INT) AS rank FROM s)"


def top(t, k):
    """The k nearest of every query (ids divisible by 20) among all rows but itself."""
    v = vectors(t)
    near = retrieve.dense_top_k(v.filter("vec_id % 20 = 0").select(c("vec_id").alias("query_id"), c("vec").alias("qv")), v.select(c("vec_id").alias("item_id"), "vec"), k + 1)
    return relational.top_k(near.filter("query_id <> item_id").drop("rank"), "query_id", k, c("score").desc(), c("item_id"))


def same_label(t):
    """(query_id, item_id) of equal label."""
    e = t.embeddings
    q = e.filter("vec_id % 20 = 0").select(c("vec_id").alias("query_id"), "label")
    return q.join(e.select(c("vec_id").alias("item_id"), "label"), "label").filter("query_id <> item_id").select("query_id", "item_id")


SAME = "same AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)"


@query(f"WITH {TOP} SELECT query_id, item_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10", adapters=False)
def embedding_topk(t):
    return top(t, 10).select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {TOP} SELECT query_id, item_id, rank FROM r WHERE rank BETWEEN 11 AND 60", adapters=False)
def nn_rank_range(t):
    return top(t, 60).filter("rank >= 11").select("query_id", "item_id", "rank")


@query(f"WITH {TOP}, {SAME}, a AS (SELECT * FROM r WHERE rank <= 30 AND NOT EXISTS (SELECT 1 FROM same k WHERE k.query_id = r.query_id AND k.item_id = r.item_id)) SELECT query_id, item_id, rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS place FROM a QUALIFY place <= 5", adapters=False)
def candidate_generation(t):
    return retrieve.candidates(top(t, 30), same_label(t), 30, 5).select("query_id", "item_id", "rank", "place")


@query("WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0) SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INT) AS rank FROM s QUALIFY rank <= 5", adapters=False)
def pool_candidates(t):
    v = vectors(t)
    q = v.filter("vec_id % 20 = 0").select(c("vec_id").alias("query_id"), c("vec").alias("qv"))
    return retrieve.dense_top_k(q, v.select(c("vec_id").alias("item_id"), "vec"), 5, same_label(t)).select("query_id", "item_id", "rank")


@query(f"""WITH {TOP}, {SAME}, truth AS (SELECT * FROM same), nt AS (SELECT query_id, count(*) AS n_true FROM truth GROUP BY 1),
  h AS (SELECT nt.query_id, n_true, k, (SELECT count(*) FROM r JOIN truth USING (query_id, item_id) WHERE r.query_id = nt.query_id AND rank <= k) AS hits FROM nt, (SELECT unnest([20, 50]) AS k)),
  g AS (SELECT k AS top_k, count(*) AS n_queries, CAST(sum(n_true) AS BIGINT) AS total_true, CAST(sum(hits) AS BIGINT) AS hits, count(*) FILTER (hits > 0) AS any_hit, count(*) FILTER (hits = n_true) AS full_hit, count(*) FILTER (hits = 0) AS zero_hit, avg(hits) AS avg_hits, median(hits) AS median_hits, sum(least(hits, 14)) AS tp FROM h GROUP BY 1)
  SELECT top_k, n_queries, total_true, hits, any_hit, full_hit, zero_hit, avg_hits, median_hits, CAST(hits AS DOUBLE) / total_true AS pair_coverage, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (n_queries * 14.0)) * (CAST(tp AS DOUBLE) / total_true) / (tp / (n_queries * 14.0) + CAST(tp AS DOUBLE) / total_true) END, 9) AS oracle_f1 FROM g""", adapters=False)
def coverage_at_k(t):
    got = evaluate.coverage_at_k(top(t, 50), same_label(t), [20, 50])
    return got.withColumn("oracle_f1", F.round("oracle_f1", 9))


@query("""WITH n AS (SELECT a.term_id AS query_id, b.term_id, count(*) / 10.0 AS sim FROM pairs a JOIN pairs b USING (item_id) WHERE a.term_id % 20 = 0 AND b.term_id <> a.term_id GROUP BY 1, 2 HAVING count(*) >= 4)
  SELECT query_id, item_id, round(CAST(max(sim) AS DOUBLE), 6) AS best, round(CAST(sum(sim) AS DOUBLE), 6) AS total, count(*) AS n FROM n JOIN pairs USING (term_id) GROUP BY 1, 2""")
def knn_transfer_score(t):
    p = t.pairs
    near = retrieve.shared_items(p).filter("term_id % 20 = 0 AND n >= 4").select(c("term_id").alias("query_id"), c("other").alias("term_id"), (c("n") / 10.0).alias("sim"))
    one = lambda how, name: retrieve.transfer(near, p, how).withColumnRenamed("score", name)
    got = one("max", "best").join(one("sum", "total"), ["query_id", "item_id"]).join(one("count", "n"), ["query_id", "item_id"])
    return got.select("query_id", "item_id", F.round("best", 6).alias("best"), F.round("total", 6).alias("total"), c("n").cast("long").alias("n"))


@query("""WITH r AS (SELECT term_id AS pair_id, term_id % 3 AS verdict, 'f' || CAST(item_id % 4 AS VARCHAR) AS file, item_id AS line FROM pairs WHERE item_id % 7 <> 0), v AS (SELECT * FROM r WHERE verdict IN (0, 1) QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY file, line) = 1)
  SELECT term_id, term_id + 1 AS item_id, CAST(verdict AS INT) AS label, CASE WHEN verdict = 1 THEN 'llm_pos' ELSE 'llm_neg' END AS src FROM v JOIN terms ON term_id = pair_id""")
def label_merge_first_wins(t):
    r = t.pairs.select(F.when(c("item_id") % 7 == 0, F.lit("x")).otherwise(c("term_id").cast("string")).alias("pair_id"), (c("term_id") % 3).cast("string").alias("verdict"), F.concat(F.lit("f"), (c("item_id") % 4).cast("string")).alias("file"), c("item_id").alias("line"))
    return retrieve.merge_labels(r, t.terms.select(c("term_id").alias("pair_id"), "term_id", (c("term_id") + 1).alias("item_id")))


# --- negatives ----------------------------------------------------------------------------------------------------------

HEX = "CAST('0x' || substr(md5('42|' || {0}), 1, 8) AS BIGINT)"


def decorated(t, pairs=None):
    i = t.items.select("item_id", F.get(F.split("category", "/"), 0).alias("main"), attrs.level(c("category"), 1).alias("sub"), "brand", "gender", "age_group", signals.colour_family(signals.colour_name(attrs.value_of(c("attributes"), "renk"))).alias("colour"))
    return (t.pairs if pairs is None else pairs).join(i, "item_id").join(negatives.typed(t.terms), "term_id"), i


def ruled(t, sources):
    pairs = io.written(t.pairs, "pairs")  # read to count those of a term and to draw
    p, i = decorated(t, pairs)
    return negatives.negatives(p, i, sources, 5, 42, pairs)


def source_sql(name: str, pool: str = "", key: str = "", when: str = "TRUE", among: str = "TRUE", block: str = "''", own: str = "NULL", tries: int = 40, most: int = 1, other: tuple[str, str] | None = None, of: str = "dp") -> str:
    """One source: its numbered pool, the blocks in it, all tries, the first valid ones. ``other``: (pool, key) where the pool is absent."""
    def numbered(n: str, cols: str) -> str:
        cols = cols or "0"
        return f"""{n}_p AS (SELECT item_id, ({cols}) AS pool, {block} AS block, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY {cols}) AS pool_size FROM di WHERE {among} WINDOW w AS (PARTITION BY {cols} ORDER BY {block}, substr(md5(CAST(item_id AS VARCHAR)), 1, 2), item_id)),
  {n}_z AS (SELECT DISTINCT pool, pool_size FROM {n}_p), {n}_b AS (SELECT pool, block, min(position) AS bs, count(*) AS bn FROM {n}_p GROUP BY 1, 2)"""

    def asked(n: str, value: str, extra: str) -> str:
        return f"SELECT d.*, ({value or '0'}) AS pool, z.pool_size, b.bs, b.bn FROM {of} d JOIN {n}_z z ON z.pool = ({value or '0'}) LEFT JOIN {n}_b b ON b.pool = z.pool AND b.block = {own} WHERE ({when}) {extra}"

    def found(n: str, src: str) -> str:
        at = HEX.format(f"'{name}|' || term_id || '|' || item_id || '|' || try")
        return f"""{n}_t AS (SELECT *, {at} % (pool_size - coalesce(bn, 0)) AS at FROM ({src}) CROSS JOIN range(0, {tries}) tr(try) WHERE pool_size > coalesce(bn, 0)),
  {n}_g AS (SELECT x.term_id, x.item_id AS pos_item, p.item_id, try FROM {n}_t x JOIN {n}_p p ON p.pool = x.pool AND p.position = x.at + CASE WHEN x.at >= coalesce(x.bs, x.pool_size) THEN x.bn ELSE 0 END WHERE p.item_id <> x.item_id AND NOT EXISTS (SELECT 1 FROM pairs k WHERE k.term_id = x.term_id AND k.item_id = p.item_id))"""

    parts, rows = [numbered(name, pool), found(name, asked(name, key, ""))], f"SELECT * FROM {name}_g"
    if other:
        o = name + "_o"
        parts += [numbered(o, other[0]), found(o, asked(o, other[1], f"AND NOT EXISTS (SELECT 1 FROM {name}_z y WHERE y.pool = ({key}))"))]
        rows += f" UNION ALL SELECT * FROM {o}_g"
    first = f"SELECT * FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY term_id, pos_item, item_id ORDER BY try) = 1"
    return ",\n  ".join([*parts, f"{name}_f AS (SELECT * FROM ({first}) QUALIFY row_number() OVER (PARTITION BY term_id, pos_item ORDER BY try) <= {most})"])


def union_sql(sources: list[dict], each: int = 5) -> str:
    """All sources in their order, no pair twice, ``each`` a positive."""
    rows = " UNION ALL ".join(f"SELECT term_id, item_id, pos_item, try, '{s['name']}' AS src, {i} AS p FROM {s['name']}_f" for i, s in enumerate(sources))
    return f"""{', '.join(source_sql(**s) for s in sources)}, u AS ({rows}), once AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY term_id, item_id ORDER BY p, try, pos_item) = 1)
  SELECT term_id, item_id, 0 AS label, src FROM once QUALIFY row_number() OVER (PARTITION BY term_id, pos_item ORDER BY p, try, item_id) <= {each}"""


DECORATED = f"""{KV}, di AS (SELECT item_id, string_split(category, '/')[1] AS main, coalesce(string_split(category, '/')[2], 'unknown') AS sub, brand, gender, age_group, {FAMILY(SYN("coalesce([x.v FOR x IN e IF x.k = 'renk'][-1], '')"))} AS colour FROM kv),
  dp AS (SELECT *, {FAMILY(SYN(has(tok('query'), L.COLOURS) + '[1]'))} AS qcolour FROM pairs JOIN terms USING (term_id) JOIN di USING (item_id))"""
MAN, WOMAN = word("d.query", "erkek"), word("d.query", "kadın", "bayan")
GENDER, AGE = f"CASE WHEN {MAN} THEN 'kadın' ELSE 'erkek' END", word("d.query", "bebek", "çocuk")
SOURCES = [
    dict(name="same_brand_diff_main", pool="brand", key="d.brand", when="d.brand <> 'unknown'", block="main", own="d.main", tries=60),
    dict(name="same_brand_diff_sub", pool="brand, main", key="d.brand, d.main", when="d.brand <> 'unknown'", block="sub", own="d.sub", tries=80),
    dict(name="gender_conflict", pool="main, gender", key=f"d.main, {GENDER}", when=f"{MAN} OR {WOMAN}", other=("gender", GENDER)),
    dict(name="age_conflict", pool="main, age_group", key="d.main, 'yetişkin'", when=AGE, other=("age_group", "'yetişkin'")),
    dict(name="color_conflict", pool="main", key="d.main", when="d.qcolour IS NOT NULL", among="colour <> ''", block="colour", own="d.qcolour", tries=60),
    dict(name="same_main_category", pool="main", key="d.main"),
    dict(name="different_main_category", block="main", own="d.main", tries=80, most=5),
]
SWAPS = [
    dict(name="brand_swap", pool="main", key="d.main", when=f"d.brand <> 'unknown' AND len(list_intersect({tok('d.query')}, [{quoted(L.ACCESSORY_WORDS)}])) = 0", among="brand <> 'unknown'", block="brand", own="d.brand", most=2),
    dict(name="gender_swap", pool="main, gender", key=f"d.main, {GENDER}", when=f"{MAN} OR {WOMAN}"),
    dict(name="age_swap", pool="main, age_group", key="d.main, 'yetişkin'", when=AGE),
    dict(name="same_cat", pool="main", key="d.main"),
]


@query(f"WITH {DECORATED}, {union_sql(SOURCES[:6])}")
def hash_draw_negatives(t):
    return ruled(t, negatives.rule_sources()[:6])


@query(f"WITH {DECORATED}, {union_sql(SOURCES)}")
def hash_draw_negatives_all_sources(t):
    return ruled(t, negatives.rule_sources())


@query(f"WITH {DECORATED}, {union_sql(SWAPS)}")
def swap_negatives(t):
    return ruled(t, negatives.swap_sources())


@query(f"""WITH {DECORATED}, {union_sql([dict(name='rare_gender', pool='main, gender', key=f"d.main, {GENDER}", when=f"{MAN} OR {WOMAN}", among="item_id % 97 = 0", other=('gender', GENDER))])}""")
def fallback_pool_negatives(t):
    """Pools so thin that most categories lack one: the pool of the whole gender takes over."""
    s = negatives.rule_sources()[2]
    s.name, s.among = "rare_gender", c("item_id") % 97 == 0
    return ruled(t, [s])


@query(f"WITH {TOP}, {SAME}, pos AS (SELECT query_id AS term_id, item_id FROM same), m AS (SELECT query_id AS term_id, item_id, rank FROM r WHERE rank BETWEEN 11 AND 60 AND NOT EXISTS (SELECT 1 FROM pos WHERE pos.term_id = query_id AND pos.item_id = r.item_id)), n AS (SELECT term_id, 2 * count(*) AS most FROM pos GROUP BY 1) SELECT term_id, item_id, rank FROM m JOIN n USING (term_id) QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY rank) <= most", adapters=False)
def mined_negatives(t):
    return negatives.mined(top(t, 60).withColumnRenamed("query_id", "term_id"), same_label(t).withColumnRenamed("query_id", "term_id"), 11, 60, 2)


@query(f"WITH di AS (SELECT DISTINCT item_id FROM pairs), {source_sql('cross_query', tries=4, most=2, of='pairs')} SELECT DISTINCT term_id, item_id FROM cross_query_f")
def cross_query_negatives(t):
    return negatives.from_other_terms(t.pairs, 42)


# --- scorers ------------------------------------------------------------------------------------------------------------

PARTS = "p AS (SELECT *, (item_id % 10) / 10.0 AS cat, (term_id % 10) / 10.0 AS conf, (item_id % 7) / 7.0 AS bm, CASE WHEN item_id % 3 = 0 THEN 0.0 ELSE score END AS knn, (item_id % 4) / 4.0 AS ov FROM scores)"


def parts(t):
    return t.scores.select("*", (c("item_id") % 10 / 10.0).alias("cat"), (c("term_id") % 10 / 10.0).alias("conf"), (c("item_id") % 7 / 7.0).alias("bm"), F.when(c("item_id") % 3 == 0, 0.0).otherwise(c("score")).alias("knn"), (c("item_id") % 4 / 4.0).alias("ov"))


@query(f"""WITH {PARTS}, g AS (SELECT *, max(knn) OVER w AS mk, avg(CASE WHEN knn > 0 THEN 1.0 ELSE 0.0 END) OVER w AS cov, min(score) OVER w AS lo, max(score) OVER w AS hi FROM p WINDOW w AS (PARTITION BY term_id))
  SELECT term_id, item_id, round(CAST(CASE WHEN conf > 0.4 AND conf < 0.6 THEN 4 * ov + 1.5 * cat + bm + 0.5 * knn WHEN 1 - conf > 0.5 THEN 2 * cat + 2 * bm + knn ELSE 0.5 * cat + 1.5 * bm + 2 * knn END AS DOUBLE), 6) AS regime,
  round(CAST(CASE WHEN knn > 0 THEN 0.5 * knn + 0.35 * cat + 0.15 * ov ELSE 0.55 * cat + 0.45 * ov END AS DOUBLE), 6) AS blend, round(CAST(CASE WHEN knn > 0.1 THEN 3 * knn + 0.5 * ov + 2 * cat WHEN conf > 0.3 AND cat > 0.5 THEN 2.5 * cat + ov ELSE ov + 0.1 * knn END AS DOUBLE), 6) AS transfer,
  round(CAST(least(0.75, 0.15 + 0.6 * cov) * CASE WHEN mk > 0 THEN knn / mk ELSE 0 END + (1 - least(0.75, 0.15 + 0.6 * cov)) * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END AS DOUBLE), 6) AS adaptive, round(CAST(CASE WHEN knn > 0 THEN knn ELSE 0.001 * bm END AS DOUBLE), 6) AS fallback, round(1 / (1 + exp(-score)), 6) AS prob FROM g""")
def rule_scorers(t):
    p = parts(t)
    conf = F.when((c("conf") > 0.4) & (c("conf") < 0.6), c("conf")).otherwise(0.0)
    return p.select(
        "term_id", "item_id", F.round(retrieve.regime_score(c("ov"), conf, 1 - c("conf"), c("cat"), c("bm"), c("knn")), 6).alias("regime"), F.round(retrieve.blend_score(c("knn"), c("knn"), c("cat"), c("ov")), 6).alias("blend"),
        F.round(retrieve.transfer_score(c("knn"), c("ov"), c("cat"), c("conf") > 0.3), 6).alias("transfer"), F.round(retrieve.adaptive_blend("term_id", "knn", "score"), 6).alias("adaptive"), F.round(retrieve.with_fallback(c("knn"), c("bm")), 6).alias("fallback"),
        F.round(retrieve.sigmoid(c("score")), 6).alias("prob"),
    )


@query("SELECT term_id * 1000000 + item_id AS id, round((2 * score + ((item_id * 13 + term_id) % 100) / 100.0) / 3, 6) AS score FROM scores")
def probability_blend(t):
    keys = ["term_id", "item_id"]
    both = retrieve.mean_of([t.scores.select(*keys, "score"), t.scores.select(*keys, ((c("item_id") * 13 + c("term_id")) % 100 / 100.0).alias("score"))], keys, [2.0, 1.0])
    return both.select((c("term_id") * 1000000 + c("item_id")).alias("id"), F.round("score", 6).alias("score"))


# --- evaluation ---------------------------------------------------------------------------------------------------------

COUNTS = "count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 0 AND pred = 0) AS tn"
PRED = "pr AS (SELECT *, CASE WHEN score >= 0.55 THEN 1 ELSE 0 END AS pred FROM scores)"


def predicted(t, threshold=0.55):
    return t.scores.withColumn("pred", (c("score") >= threshold).cast("int"))


def f1(a, b, d):
    return f"CASE WHEN 2 * {a} + {b} + {d} = 0 THEN 0.0 ELSE 2.0 * {a} / (2 * {a} + {b} + {d}) END"


@query(f"WITH {PRED}, g AS (SELECT {COUNTS} FROM pr) SELECT tp, fp, fn, tn, round(CAST(({f1('tp', 'fp', 'fn')} + {f1('tn', 'fn', 'fp')}) / 2 AS DOUBLE), 9) AS macro_f1 FROM g")
def confusion_and_macro_f1(t):
    g = predicted(t).agg(*evaluate.confusion(c("label"), c("pred")))
    return g.select("*", F.round(evaluate.macro_f1(c("tp"), c("fp"), c("fn"), c("tn")), 9).alias("macro_f1"))


@query(f"""WITH {PRED}, g AS (SELECT term_id, {COUNTS} FROM pr GROUP BY 1) SELECT term_id, tp, fp, fn, tn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall, round(CAST({f1('tp', 'fp', 'fn')} AS DOUBLE), 9) AS f1,
  round(CAST((CASE WHEN tp + fp + fn > 0 THEN {f1('tp', 'fp', 'fn')} ELSE 0 END + CASE WHEN tn + fn + fp > 0 THEN {f1('tn', 'fn', 'fp')} ELSE 0 END) / (CAST(tp + fp + fn > 0 AS INT) + CAST(tn + fn + fp > 0 AS INT)) AS DOUBLE), 9) AS macro_f1 FROM g""")
def macro_f1_per_query(t):
    g = evaluate.per_group(predicted(t), "term_id", "label", "pred")
    return g.withColumn("f1", F.round("f1", 9)).withColumn("macro_f1", F.round("macro_f1", 9))


@query("""WITH h AS (SELECT CASE WHEN value < 1 THEN 0 WHEN value < 5 THEN 1 WHEN value < 20 THEN 2 WHEN value < 50 THEN 3 ELSE 4 END AS bin FROM events WHERE value >= 0 AND value < 1000) SELECT CAST(bin AS INT) AS bin, CAST([0, 1, 5, 20, 50][bin + 1] AS DOUBLE) AS low, count(*) AS n FROM h GROUP BY 1, 2""", adapters=False)
def histogram_bins(t):
    return evaluate.histogram(t.events, c("value"), [0, 1, 5, 20, 50, 1000])


@query(f"WITH {PRED}, o AS (SELECT CASE WHEN label = 1 AND pred = 1 THEN 'tp' WHEN label = 0 AND pred = 1 THEN 'fp' WHEN label = 1 THEN 'fn' ELSE 'tn' END AS outcome, score, CAST(item_id % 10 AS DOUBLE) AS f FROM pr) SELECT outcome, 'score' AS feature, round(avg(score), 6) AS mean FROM o GROUP BY 1 UNION ALL SELECT outcome, 'f', round(avg(f), 6) FROM o GROUP BY 1")
def class_profile(t):
    o = F.when((c("label") == 1) & (c("pred") == 1), "tp").when((c("label") == 0) & (c("pred") == 1), "fp").when(c("label") == 1, "fn").otherwise("tn")
    d = predicted(t).select(o.alias("outcome"), "score", (c("item_id") % 10).cast("double").alias("f"))
    return evaluate.profile(d, "outcome", ["score", "f"]).select("outcome", "feature", F.round("mean", 6).alias("mean"))


@query("WITH r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scores), a AS (SELECT (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label = 0)) AS raw FROM r) SELECT round(CAST(greatest(raw, 1 - raw) AS DOUBLE), 9) AS auc, raw < 0.5 AS flipped FROM a")
def rank_auc(t):
    return evaluate.auc(t.scores, "label", "score").select(F.round("auc", 9).alias("auc"), "flipped")


@query("""WITH a AS (SELECT *, CASE WHEN score >= 0.55 THEN 1 ELSE 0 END AS pa, CASE WHEN score >= 0.4 AND item_id % 9 <> 0 THEN 1 ELSE 0 END AS pb FROM scores JOIN items USING (item_id))
  SELECT gender, count(*) FILTER (pa = 0 AND pb = 1) AS up, count(*) FILTER (pa = 1 AND pb = 0) AS down, count(*) FILTER (pa <> pb) AS flips, count(*) FILTER (pa = 0 AND pb = 1) - count(*) FILTER (pa = 1 AND pb = 0) AS net, count(*) AS n FROM a GROUP BY 1""")
def flip_analysis(t):
    keys = ["term_id", "item_id"]
    a = predicted(t).join(t.items.select("item_id", "gender"), "item_id").select(*keys, "pred", "gender")
    b = t.scores.select(*keys, ((c("score") >= 0.4) & (c("item_id") % 9 != 0)).cast("int").alias("pred"))
    return evaluate.flips(a, b, keys, c("gender"), "gender")


@query("SELECT CASE WHEN score >= 0.55 THEN 1 ELSE 0 END AS a, CASE WHEN score >= 0.4 THEN 1 ELSE 0 END AS b, count(*) AS n FROM scores GROUP BY 1, 2")
def agreement_matrix(t):
    return t.scores.groupBy((c("score") >= 0.55).cast("int").alias("a"), (c("score") >= 0.4).cast("int").alias("b")).agg(F.count("*").alias("n"))


SWEEP = f"""sw AS (SELECT CAST(i AS INT) AS i, i / CAST(200 AS DOUBLE) AS threshold, {COUNTS.replace('pred = 1', 'round(score * 200, 9) >= i').replace('pred = 0', 'round(score * 200, 9) < i')}, count(*) FILTER (round(score * 200, 9) >= i) AS positives FROM scores, range(40, 181) g(i) GROUP BY i), swept AS (SELECT threshold, ({f1('tp', 'fp', 'fn')} + {f1('tn', 'fn', 'fp')}) / 2 AS macro_f1, positives FROM sw)"""


@query(f"WITH {SWEEP} SELECT threshold, round(CAST(macro_f1 AS DOUBLE), 9) AS macro_f1, positives FROM swept")
def threshold_sweep(t):
    return evaluate.sweep(t.scores, "label", "score", 40, 180, 200).select("threshold", F.round("macro_f1", 9).alias("macro_f1"), "positives")


@query(f"WITH {SWEEP} SELECT threshold, round(CAST(macro_f1 AS DOUBLE), 9) AS macro_f1, positives FROM swept ORDER BY round(macro_f1, 12) DESC, threshold LIMIT 1")
def best_threshold(t):
    return evaluate.best_threshold(evaluate.sweep(t.scores, "label", "score", 40, 180, 200)).select("threshold", F.round("macro_f1", 9).alias("macro_f1"), "positives")


@query(f"WITH {SWEEP} SELECT threshold, positives FROM swept ORDER BY abs(positives - (SELECT count(*) // 3 FROM scores)), threshold LIMIT 1")
def target_count_threshold(t):
    target = t.scores.count() // 3
    return evaluate.threshold_by_count(evaluate.sweep(t.scores, "label", "score", 40, 180, 200), target).select("threshold", "positives")


@query("""WITH o AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i FROM scores), k AS (SELECT (1 - avg(label)) * (count(*) - 1) AS k FROM scores)
  SELECT round((SELECT score FROM o, k WHERE i = floor(k)) + ((SELECT k - floor(k) FROM k)) * ((SELECT score FROM o, k WHERE i = ceil(k)) - (SELECT score FROM o, k WHERE i = floor(k))), 9) AS by_rate, round((SELECT quantile_cont(score, 0.9) FROM scores), 9) AS q90""")
def quantile_threshold(t):
    rate = t.scores.agg(F.avg("label")).first()[0] or 0.0
    return t.scores.agg(F.round(F.percentile("score", 1 - rate), 9).alias("by_rate"), F.round(F.percentile("score", 0.9), 9).alias("q90"))


@query("SELECT term_id, CAST(CAST('0x' || substr(md5('42|' || CAST(term_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS INT) AS fold, count(*) AS n FROM pairs GROUP BY 1, 2")
def group_folds(t):
    return t.pairs.select("term_id", model.fold_of("term_id").alias("fold")).groupBy("term_id", "fold").agg(F.count("*").alias("n"))


#: Features of the trees: all of them built in the JVM.
TREE_FEATURES = ["jaccard", "q_cov_title", "t_cov_query", "cat_overlap", "stem_jaccard", "head_in_title", "weighted_q_cov", "product_type_cover", "brand_weight", "gender_cross", "age_cross", "clue"]


def training(t):
    """All pairs with lexical and typed features, and a label that one of them explains in part."""
    from quarry.functions import similarity
    from quarry.plans.text_features import lean_pairs

    p = lean_pairs(t).withColumn("label", ((c("term_id") + c("item_id")) % 3 == 0).cast("int"))
    q, tt, ct = c("q"), c("tt"), c("ct")
    return p.select(
        "term_id", "item_id", "label", "gender", similarity.jaccard(q, tt).alias("jaccard"), similarity.coverage(q, tt).alias("q_cov_title"), similarity.coverage(tt, q).alias("t_cov_query"), similarity.jaccard(q, ct).alias("cat_overlap"),
        similarity.jaccard(c("sq"), c("st")).alias("stem_jaccard"), similarity.head_match(q, tt, word_stems=c("st"), head=c("head")).alias("head_in_title"), similarity.weighted_coverage(q, tt, word_stems=c("st"), content=c("content")).alias("weighted_q_cov"),
        similarity.product_cover(c("query"), q, tt, c("brand"), word_stems=c("st"), product=c("product"), brand_words=c("bt"), plain=c("plain")).alias("product_type_cover"), similarity.brand_weight(q, c("brand"), c("bt")).alias("brand_weight"),
        signals.gender_cross(c("query"), c("gender")).alias("gender_cross"), signals.age_cross(c("query"), c("age_group")).alias("age_cross"), ((c("term_id") + c("item_id")) % 3 + c("item_id") % 7 * 0.18).cast("double").alias("clue"),
    )


@query()
def gbt_oof(t):
    """Five grouped folds with early stopping, the operator's own settings."""
    scored, _ = model.oof_scores(training(t), TREE_FEATURES, "label", "term_id", ["gender"])
    return scored.select("term_id", "item_id", "label", "fold", F.round("score", 6).alias("score"))


@query()
def distill_labels(t):
    """Verdicts behind the gate of 0.88; where it isn't reached, one row that says so."""
    d = io.written(training(t), "training")
    score, verdicts = model.distill(d.filter("gender <> 'unknown'"), d.filter("gender = 'unknown'"), TREE_FEATURES, "label", "term_id", write=True, stored=True)
    if verdicts is None:
        return t.spark.createDataFrame([(None, None, None, "gate not reached", float(score))], "term_id long, item_id long, verdict int, gate string, macro_f1 double")
    return verdicts.select("term_id", "item_id", "verdict", F.lit("reached").alias("gate"), F.lit(round(float(score), 6)).alias("macro_f1"))
