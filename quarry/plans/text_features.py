"""Queries: normalisation, tokens, paths and maps, similarity features, typed signals, dictionaries, parsing, weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import attrs, signals, similarity, text
from quarry.functions import lexicon as L
from quarry.operators import dictionary, nearest, parse, relational, weights
from quarry.plans.registry import query, quoted, tok

c = F.col
LOWER = "trim(lower(translate({}, 'İIŞĞÜÖÇ', 'iışğüöç')))"
FOLD = "trim(regexp_replace(lower(translate({}, 'İIıŞşĞğÜüÖöÇç', 'iiissgguuoocc')), '\\s+', ' ', 'g'))"
STEM = "regexp_replace({}, '" + L.suffix_pattern().replace("{", "{{").replace("}", "}}") + "', '\\1')"
LETTERS = L.LETTERS


def word(x: str, *ws: str) -> str:
    return f"regexp_matches({x}, '{L.whole_word(*ws)}')"


def has(x: str, ws) -> str:
    """DuckDB: words of the list ``x`` that are in ``ws``."""
    return f"[w FOR w IN {x} IF w IN ({quoted(ws)})]"


def _query_words(q):
    """Queries with their tokens, and what is made of these."""
    q = q.withColumn("q", text.tokens(c("query")))
    return q.select("*", similarity.query_head(c("q")).alias("head"), similarity.content_words(c("q")).alias("content"), similarity.product_words(c("q")).alias("product"), similarity.plain_tokens(c("query")).alias("plain"), text.stems(c("q")).alias("sq"))


def _item_words(i):
    """Items with their tokens, and what is made of these."""
    i = i.select("*", text.tokens(c("title")).alias("tt"), text.tokens(F.replace(c("category"), F.lit("/"), F.lit(" "))).alias("ct"))
    return i.select("*", text.stems(c("tt")).alias("st"), text.stems(c("ct")).alias("sc"), similarity.brand_tokens(c("brand")).alias("bt"))


def per_pair(t, *extra: str):
    """Pairs with tokens and stems made once for each term and each item, before the join; what a query doesn't use is never made."""
    return t.pairs.join(_query_words(t.terms), "term_id").join(_item_words(t.items), "item_id")


def lean_pairs(t):
    """``per_pair`` for queries that use most of it: a pair is shuffled with short texts of its query, the words, stems and plain tokens as one line each.

    Lists of words are many times their text, and as many times as there are pairs. After the last join lines are only split, no pattern is tried.
    No side is broadcast by the size of its files.
    """
    terms = t.terms.withColumn("q", text.tokens(c("query")))
    plain, line = similarity.plain_tokens(c("query")), lambda ws: F.array_join(ws, " ")
    terms = terms.select("term_id", "query", line(c("q")).alias("_q"), line(text.stems(c("q"))).alias("_s"), F.when(plain != c("q"), line(plain)).alias("_p"))
    p = t.pairs.join(terms.hint("merge"), "term_id").join(_item_words(t.items).hint("merge"), "item_id")
    words = lambda x: F.filter(F.split(x, " "), lambda w: w != "")
    p = p.withColumn("q", words(c("_q"))).withColumn("sq", words(c("_s")))
    p = p.withColumn("plain", F.coalesce(words(c("_p")), c("q"))).withColumn("_w", F.transform("q", lambda w, i: F.struct(w.alias("w"), F.get(c("sq"), i).alias("s"))))
    return p.withColumns({"head": similarity.head_of(c("_w")), "content": similarity.content_of(c("_w")), "product": similarity.product_of(c("_w"))}).drop("_q", "_s", "_p", "_w")


PAIR = f"""qt AS (SELECT term_id, query, {tok('query')} AS q FROM terms), it AS (SELECT *, {tok('title')} AS tt, {tok("replace(category, '/', ' ')")} AS ct FROM items),
 pp AS (SELECT * FROM pairs JOIN qt USING (term_id) JOIN it USING (item_id))"""
JAC = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 0.0 ELSE CAST(len(list_intersect({0}, {1})) AS DOUBLE) / len(list_distinct(list_concat({0}, {1}))) END"
COV = "CASE WHEN len({0}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({0}, {1})) AS DOUBLE) / len(list_distinct({0})) END"


def stems_sql(x: str, v: str = "s") -> str:
    return f"[{STEM.format(v)} FOR {v} IN {x}]"


@query(f"""SELECT doc_id, md5({LOWER.format('text')}) AS lower_md5, md5({FOLD.format('text')}) AS folded_md5, CAST(len([w FOR w IN string_split_regex(trim(text), '\\s+') IF w <> '']) AS INT) AS n_tokens,
  CAST(len([w FOR w IN string_split_regex({LOWER.format('text')}, '[^0-9a-zçğıöşü]+') IF length(w) >= 2]) AS INT) AS n_words, CAST(len(regexp_extract_all({FOLD.format('text')}, '[a-z0-9]+')) AS INT) AS n_ascii FROM documents""", adapters=False)
def normalise_texts(t):
    low = text.lower_tr(c("text"))
    return t.documents.select(
        "doc_id", F.md5(low).alias("lower_md5"), F.md5(text.fold(c("text"))).alias("folded_md5"), F.size(text.tokens(c("text"))).alias("n_tokens"),
        F.size(text.word_tokens(low)).alias("n_words"), F.size(text.ascii_tokens(c("text"))).alias("n_ascii"),
    )


@query(f"SELECT item_id, array_to_string({stems_sql(tok('title'))}, ' ') AS stems, round(CAST(len([w FOR w IN {tok('title')} IF regexp_matches(w, '{L.suffix_pattern()}')]) AS DOUBLE) / greatest(1, len({tok('title')})), 9) AS suffixed FROM items")
def stem_tokens(t):
    ws = text.tokens(c("title"))
    return t.items.select("item_id", F.array_join(text.stems(ws), " ").alias("stems"), F.round(text.suffixed_ratio(ws), 9).alias("suffixed"))


@query(rf"""WITH t AS (SELECT term_id, {tok('query')} AS ws FROM terms) SELECT term_id, array_to_string(list_concat(ws, list_concat([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))], [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)])), '|') AS grams FROM t""")
def word_ngrams(t):
    return t.terms.select("term_id", F.array_join(text.word_ngrams(text.tokens(c("query"))), "|").alias("grams"))


@query(rf"""WITH w AS (SELECT DISTINCT unnest({tok('query')}) AS w FROM terms), p AS (SELECT w, ' ' || w || ' ' AS x FROM w)
  SELECT w, array_to_string(list_concat([x[i:i + 2] FOR i IN range(1, greatest(length(x) - 2, 1) + 1)], list_concat(CASE WHEN length(x) > 3 THEN [x[i:i + 3] FOR i IN range(1, greatest(length(x) - 3, 1) + 1)] ELSE [] END, CASE WHEN length(x) > 4 THEN [x[i:i + 4] FOR i IN range(1, greatest(length(x) - 4, 1) + 1)] ELSE [] END)), '|') AS grams FROM p""")
def char_ngrams(t):
    return t.terms.select(F.explode(text.tokens(c("query"))).alias("w")).distinct().select("w", F.array_join(text.char_ngrams(F.array("w")), "|").alias("grams"))


@query(r"""SELECT page_id, length(trim(substr(regexp_replace(html, '[\x00-\x1f\x7f-\x{9f}]', ' ', 'g'), 1, 400))) AS n_clean, md5(regexp_replace(lower(html), '[^a-z0-9çğıöşü\s]', ' ', 'g')) AS stripped FROM pages""", adapters=False)
def text_clean(t):
    return t.pages.select("page_id", F.length(text.clean_control(c("html"))).cast("long").alias("n_clean"), F.md5(text.strip_punctuation(F.lower("html"))).alias("stripped"))


@query(f"""WITH t AS (SELECT term_id, query, {tok('query')} AS ws FROM terms), k AS (SELECT *, [w FOR w IN ws IF w NOT IN ({quoted(L.STOP_FUNCTION)}) AND length(w) > 1] AS cw FROM t)
  SELECT term_id, CAST(length(query) AS INT) AS chars, CAST(len(ws) AS INT) AS n, coalesce(cw[-1], ws[-1], '') AS head, coalesce(ws[1], '') AS first_token, len([w FOR w IN ws IF length(w) > 10]) > 0 AS long_word, regexp_matches(query, '[0-9]') AS has_digit, regexp_matches(query, '[a-z]{{3,}}') AS latin FROM k""")
def token_shape(t):
    ws = text.tokens(c("query"))
    return t.terms.select(
        "term_id", F.length("query").alias("chars"), F.size(ws).alias("n"), text.head_noun(ws).alias("head"), F.coalesce(F.try_element_at(ws, F.lit(1)), F.lit("")).alias("first_token"),
        F.exists(ws, lambda w: F.length(w) > 10).alias("long_word"), c("query").rlike("[0-9]").alias("has_digit"), c("query").rlike("[a-z]{3,}").alias("latin"),
    )


@query("""WITH s AS (SELECT *, [trim(x) FOR x IN string_split(category, '/') IF trim(x) <> ''] AS g FROM items)
  SELECT item_id, coalesce(g[1], '') AS l1, coalesce(g[2], '') AS l2, coalesce(g[3], '') AS l3, coalesce(g[-1], '') AS leaf, CAST(len(g) AS INT) AS depth, coalesce(string_split(category, '/')[1], 'unknown') AS main, coalesce(string_split(category, '/')[3], 'unknown') AS third FROM s""")
def category_path_split(t):
    g = attrs.segments(c("category"))
    at = lambda i: F.coalesce(F.try_element_at(g, F.lit(i)), F.lit(""))
    return t.items.select("item_id", at(1).alias("l1"), at(2).alias("l2"), at(3).alias("l3"), at(-1).alias("leaf"), F.size(g).alias("depth"), attrs.level(c("category"), 0).alias("main"), attrs.level(c("category"), 2).alias("third"))


KV = """kv AS (SELECT item_id, CASE WHEN attributes = 'unknown' THEN [] ELSE [struct_pack(k := trim(substring(p, 1, instr(p, ':') - 1)), v := trim(substring(p, instr(p, ':') + 1))) FOR p IN string_split(attributes, ',') IF contains(p, ':')] END AS e, * EXCLUDE (item_id) FROM items)"""


@query(f"""WITH {KV}, f AS (SELECT *, coalesce([x.v FOR x IN e IF x.k = 'renk'][-1], '') AS renk, coalesce([x.v FOR x IN e IF x.k = 'materyal bileşeni'][-1], [x.v FOR x IN e IF x.k = 'materyal'][-1], '') AS mat FROM kv)
  SELECT item_id, renk, mat, coalesce([x.v FOR x IN e IF x.k = 'kol boyu'][-1], [x.v FOR x IN e IF x.k = 'kol tipi'][-1], '') AS kol,
  array_to_string([z FOR z IN [CASE WHEN title NOT IN ('', 'unknown') THEN title END, CASE WHEN brand NOT IN ('', 'unknown') THEN brand END, CASE WHEN string_split(category, '/')[1] NOT IN ('', 'unknown') THEN string_split(category, '/')[1] END,
   CASE WHEN renk NOT IN ('', 'unknown') THEN 'renk:' || renk END, CASE WHEN mat NOT IN ('', 'unknown') THEN 'mat:' || substr(mat, 1, 25) END] IF z IS NOT NULL], ' | ') AS item_text FROM f""")
def attr_map_extract(t):
    a = c("attributes")
    return t.items.select("item_id", attrs.value_of(a, "renk").alias("renk"), attrs.value_of(a, "materyal bileşeni", "materyal").alias("mat"), attrs.value_of(a, "kol boyu", "kol tipi").alias("kol"), attrs.item_text(c("title"), c("brand"), c("category"), a).alias("item_text"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", adapters=False)
def json_props(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"""WITH {PAIR} SELECT term_id, item_id, {JAC.format('q', 'tt')} AS jaccard, {COV.format('q', 'tt')} AS q_cov_title, {COV.format('tt', 'q')} AS t_cov_query, CAST(len(list_intersect(q, tt)) AS INT) AS token_overlap,
  CAST(contains(title, query) AS DOUBLE) AS exact_in_title, CAST(len(list_intersect(q, tt)) = len(list_distinct(q)) AS DOUBLE) AS all_q_in_title, {JAC.format('q', 'ct')} AS cat_overlap, {JAC.format(stems_sql('q', 'a'), stems_sql('tt', 'b'))} AS stem_jaccard,
  {JAC.format(stems_sql('q', 'a'), stems_sql('ct', 'b'))} AS stem_cat_jac, CAST(age_group NOT IN ('unknown', '') AND contains(query, age_group) AS DOUBLE) AS age_in_q, CAST(contains(title, q[1]) AS DOUBLE) AS first_tok_title, CAST(brand <> 'unknown' AND contains(brand, q[1]) AS DOUBLE) AS first_tok_brand FROM pp""")
def lexical_similarity(t):
    p, q, tt, ct = per_pair(t), c("q"), c("tt"), c("ct")
    sq, st, sc = c("sq"), c("st"), c("sc")
    first = F.try_element_at(q, F.lit(1))
    return p.select(
        "term_id", "item_id", similarity.jaccard(q, tt).alias("jaccard"), similarity.coverage(q, tt).alias("q_cov_title"), similarity.coverage(tt, q).alias("t_cov_query"), similarity.overlap(q, tt).alias("token_overlap"),
        F.contains("title", c("query")).cast("double").alias("exact_in_title"), similarity.subset(q, tt).alias("all_q_in_title"), similarity.jaccard(q, ct).alias("cat_overlap"), similarity.jaccard(sq, st).alias("stem_jaccard"),
        similarity.jaccard(sq, sc).alias("stem_cat_jac"), similarity.contains_known(c("query"), c("age_group")).alias("age_in_q"), F.coalesce(F.contains(c("title"), first), F.lit(False)).cast("double").alias("first_tok_title"),
        F.coalesce((c("brand") != "unknown") & F.contains(c("brand"), first), F.lit(False)).cast("double").alias("first_tok_brand"),
    )


HEAD = """CASE WHEN h = '' THEN 0.0 WHEN list_contains({0}, h) THEN 1.0 WHEN list_contains({1}, hs) THEN 0.8 WHEN length(hs) >= 5 AND len([x FOR x IN {0} IF starts_with(x, substr(hs, 1, 5))]) > 0 THEN 0.4 ELSE 0.0 END"""


@query(f"""WITH {PAIR}, a AS (SELECT *, [w FOR w IN q IF w NOT IN ({quoted(L.STOP_FUNCTION)}) AND length(w) > 1] AS cw, {stems_sql('tt')} AS ts, {stems_sql('ct')} AS cs FROM pp), b AS (SELECT *, coalesce(cw[-1], q[-1], '') AS h FROM a), d AS (SELECT *, {STEM.format('h')} AS hs FROM b),
  x AS (SELECT term_id, item_id, unnest(cw) AS w, unnest(range(1, len(cw) + 1)) AS i, len(cw) AS n, tt, ts FROM d),
  m AS (SELECT term_id, item_id, sum(CASE WHEN list_contains(tt, w) OR list_contains(ts, {STEM.format('w')}) OR (length({STEM.format('w')}) >= 5 AND len([y FOR y IN tt IF starts_with(y, substr({STEM.format('w')}, 1, 5))]) > 0) THEN CASE WHEN i = n THEN 2.0 ELSE 1.0 END ELSE 0.0 END) / (max(n) + 1.0) AS wc FROM x GROUP BY 1, 2)
  SELECT term_id, item_id, CAST({HEAD.format('tt', 'ts')} AS DOUBLE) AS head_in_title, CAST({HEAD.format('ct', 'cs')} AS DOUBLE) AS head_in_cat, round(CAST(coalesce(wc, {COV.format('q', 'tt')}) AS DOUBLE), 9) AS weighted_q_cov FROM d LEFT JOIN m USING (term_id, item_id)""")
def head_coverage(t):
    q, tt, ct = c("q"), c("tt"), c("ct")
    return per_pair(t).select("term_id", "item_id", similarity.head_match(q, tt, word_stems=c("st"), head=c("head")).alias("head_in_title"), similarity.head_match(q, ct, word_stems=c("sc"), head=c("head")).alias("head_in_cat"), F.round(similarity.weighted_coverage(q, tt, word_stems=c("st"), content=c("content")), 9).alias("weighted_q_cov"))


BT = "CASE WHEN brand IN ('', 'unknown') THEN [] ELSE list_distinct([w FOR w IN string_split_regex(trim(regexp_replace(brand, '[^a-z0-9çğıöşü\\s]', ' ', 'g')), '\\s+') IF length(w) > 1]) END"
TYPED = quoted([*L.GENDER_WORDS, *L.AGE_WORDS, *L.COLOURS, *L.MATERIAL_WORDS, *L.STOP_FUNCTION])


@query(f"""WITH {PAIR}, a AS (SELECT *, {BT} AS bt, {stems_sql('tt')} AS ts FROM pp), b AS (SELECT *, {COV.format('bt', 'q')} AS ov FROM a),
  d AS (SELECT *, [w FOR w IN q IF w NOT IN ({TYPED}) AND length(w) > 1 AND NOT (ov > 0.3 AND list_contains(bt, w))] AS kw FROM b), x AS (SELECT term_id, item_id, unnest(kw) AS w, len(kw) AS n, tt, ts FROM d),
  m AS (SELECT term_id, item_id, CAST(count(*) FILTER (list_contains(tt, w) OR list_contains(ts, {STEM.format('w')}) OR (length({STEM.format('w')}) >= 5 AND len([y FOR y IN tt IF starts_with(y, substr({STEM.format('w')}, 1, 5))]) > 0)) AS DOUBLE) / max(n) AS pc FROM x GROUP BY 1, 2)
  SELECT term_id, item_id, ov AS brand_tok_ovlp, CAST(len([w FOR w IN q IF list_contains(bt, w)]) AS DOUBLE) / len(q) AS brand_weight, round(coalesce(pc, {COV.format('q', 'tt')}), 9) AS product_type_cover FROM d LEFT JOIN m USING (term_id, item_id)""")
def brand_and_product(t):
    q, tt, b, qt = c("q"), c("tt"), c("brand"), c("query")
    return per_pair(t).select("term_id", "item_id", similarity.brand_overlap(qt, b, c("bt"), c("plain")).alias("brand_tok_ovlp"), similarity.brand_weight(q, b, c("bt")).alias("brand_weight"), F.round(similarity.product_cover(qt, q, tt, b, word_stems=c("st"), product=c("product"), brand_words=c("bt"), plain=c("plain")), 9).alias("product_type_cover"))


@query(f"""WITH {PAIR}, {KV}, v AS (SELECT item_id, len(e) > 0 AS filled, {tok("array_to_string([[y.v FOR y IN e IF y.k = k][-1] FOR k IN (SELECT list(k2 ORDER BY i2) FROM (SELECT k2, min(i2) AS i2 FROM (SELECT unnest([y.k FOR y IN e]) AS k2, unnest(range(len(e))) AS i2) GROUP BY k2))], ' ')")} AS av, {tok('attributes')} AS raw FROM kv)
  SELECT term_id, item_id, CASE WHEN filled THEN {JAC.format('q', 'av')} ELSE {JAC.format('q', 'raw')} END AS attr_jac, CASE WHEN filled THEN {COV.format('q', 'av')} ELSE 0.0 END AS attr_q_cov FROM pp JOIN v USING (item_id)""")
def attribute_overlap(t):
    a = c("attributes")
    return per_pair(t).select("term_id", "item_id", similarity.attribute_jaccard(c("q"), a).alias("attr_jac"), similarity.attribute_coverage(c("q"), a).alias("attr_q_cov"))


FAMILY = lambda x: "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.COLOUR_FAMILY.items()) + f" ELSE {x} END"
SYN = lambda x: "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.COLOUR_SYNONYM.items()) + f" ELSE {x} END"
MAT = lambda x: "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.MATERIAL.items()) + " END"


@query(f"""WITH {PAIR}, {KV}, v AS (SELECT item_id, coalesce([x.v FOR x IN e IF x.k = 'renk'][-1], '') AS renk, coalesce([x.v FOR x IN e IF x.k = 'materyal bileşeni'][-1], [x.v FOR x IN e IF x.k = 'materyal'][-1], '') AS mat, coalesce([x.v FOR x IN e IF x.k = 'kol boyu'][-1], [x.v FOR x IN e IF x.k = 'kol tipi'][-1], '') AS kol FROM kv),
  a AS (SELECT *, {SYN(has('q', L.COLOURS) + '[1]')} AS qc, [z FOR z IN [{MAT('w')} FOR w IN q] IF z IS NOT NULL] AS qm, list_distinct([w FOR w IN q IF regexp_matches(w, '[0-9]')]) AS qk, list_distinct([w FOR w IN list_concat(tt, {tok('attributes')}) IF regexp_matches(w, '[0-9]')]) AS tk,
   {word('query', 'kadın', 'bayan')} AS qw, {word('query', 'erkek')} AS qe, {word('query', 'bebek', 'bebekler')} AS qb, {word('query', 'çocuk', 'çocuklar')} AS qh, {word('query', 'yetişkin')} AS qa FROM pp JOIN v USING (item_id))
  SELECT term_id, item_id, CAST(CASE WHEN (qw AND gender = 'erkek') OR (qe AND gender IN ('kadın', 'bayan', 'kız')) THEN -1 WHEN (qw AND gender IN ('kadın', 'bayan', 'kız')) OR (qe AND gender = 'erkek') THEN 1 ELSE 0 END AS DOUBLE) AS gender_cross,
  CAST(CASE WHEN age_group IN ('unknown', '') THEN 0 WHEN (qb AND age_group IN ('bebek', 'bebek & çocuk')) OR (qh AND age_group IN ('çocuk', 'bebek & çocuk', 'genç')) OR (qa AND age_group = 'yetişkin') THEN 1
    WHEN (qb AND age_group = 'yetişkin') OR (qa AND age_group IN ('bebek', 'bebek & çocuk')) OR (qh AND age_group = 'yetişkin') OR (qa AND age_group IN ('çocuk', 'bebek & çocuk', 'genç')) THEN -1 ELSE 0 END AS DOUBLE) AS age_cross,
  CAST(CASE WHEN qc IS NULL OR renk = '' THEN 0 WHEN qc = renk THEN 2 WHEN {FAMILY('qc')} = {FAMILY('renk')} THEN 1 ELSE -1 END AS DOUBLE) AS color_typed, CAST(qc IS NOT NULL AS INT) AS has_q_color, CAST(renk <> '' AS INT) AS attr_has_renk,
  CAST(mat <> '' AND len([z FOR z IN qm IF contains(mat, z)]) > 0 AS DOUBLE) AS material_match, CAST(CASE WHEN len(qm) = 0 OR mat = '' THEN 0 WHEN contains(mat, qm[1]) THEN 1 ELSE -1 END AS DOUBLE) AS material_mismatch,
  CAST((contains(query, 'uzun') AND contains(kol, 'uzun')) OR (contains(query, 'kısa') AND contains(kol, 'kısa')) OR (contains(query, 'kolsuz') AND contains(kol, 'kolsuz')) AS DOUBLE) AS kol_boyu_match,
  CAST(CASE WHEN len(qk) = 0 THEN 0 WHEN len(tk) = 0 OR len(list_intersect(qk, tk)) = 0 THEN -1 WHEN len(list_intersect(qk, tk)) = len(qk) THEN 1 ELSE 0 END AS DOUBLE) AS spec_code_match FROM a""")
def typed_signals(t):
    a, q = c("attributes"), c("q")
    colour, material = attrs.value_of(a, "renk"), attrs.value_of(a, "materyal bileşeni", "materyal")
    qc = signals.query_colour(q)
    return per_pair(t).select(
        "term_id", "item_id", signals.gender_cross(c("query"), c("gender")).alias("gender_cross"), signals.age_cross(c("query"), c("age_group")).alias("age_cross"), signals.colour_match(qc, colour).alias("color_typed"),
        qc.isNotNull().cast("int").alias("has_q_color"), (colour != "").cast("int").alias("attr_has_renk"), signals.material_match(q, material).alias("material_match"), signals.material_mismatch(q, material).alias("material_mismatch"),
        signals.sleeve_match(c("query"), attrs.value_of(a, "kol boyu", "kol tipi")).alias("kol_boyu_match"), signals.code_match(q, F.concat(c("tt"), text.tokens(a))).alias("spec_code_match"),
    )


@query(f"""WITH {PAIR}, a AS (SELECT term_id, item_id, regexp_extract_all({FOLD.format('query')}, '[a-z0-9]+') AS fq, regexp_extract_all({FOLD.format('title')}, '[a-z0-9]+') AS ft, regexp_extract_all({FOLD.format('brand')}, '[a-z0-9]+') AS fb, {FOLD.format('gender')} AS g FROM pp),
  b AS (SELECT *, len({has('fq', ['kadin', 'bayan', 'kiz'])}) > 0 AS qw, len({has('fq', ['erkek'])}) > 0 AS qm, g IN ('kadin', 'bayan', 'kiz') OR len({has('ft', ['kadin', 'bayan', 'kiz'])}) > 0 AS iw, g = 'erkek' OR len({has('ft', ['erkek'])}) > 0 AS im, list_distinct({has('fq', L.FOLDED_COLOURS)}) AS qc, list_distinct({has('ft', L.FOLDED_COLOURS)}) AS tc,
   [w FOR w IN fq IF w NOT IN ({quoted([*L.FOLDED_STOP, *L.FOLDED_GENDER, *L.FOLDED_AGE, *L.FOLDED_COLOURS, *L.FOLDED_MATERIALS])}) AND length(w) > 1 AND NOT list_contains(fb, w)] AS kw FROM a)
  SELECT term_id, item_id, CAST(CASE WHEN (qw AND im) OR (qm AND iw) THEN -1 WHEN (qw AND iw) OR (qm AND im) THEN 1 ELSE 0 END AS DOUBLE) AS gender_signal, CAST(CASE WHEN len(qc) = 0 OR len(tc) = 0 THEN 0 WHEN len(list_intersect(qc, tc)) > 0 THEN 1 ELSE -1 END AS DOUBLE) AS color_signal,
  round(CASE WHEN len(kw) = 0 THEN {COV.format('fq', 'ft')} ELSE CAST(len([w FOR w IN kw IF list_contains(ft, w)]) AS DOUBLE) / len(kw) END, 9) AS product_cover FROM b""")
def folded_signals(t):
    q, title = c("query"), c("title")
    return per_pair(t).select("term_id", "item_id", signals.folded_gender(q, c("gender"), title).alias("gender_signal"), signals.folded_colour(q, title).alias("color_signal"), F.round(signals.folded_product_cover(q, title, c("brand")), 9).alias("product_cover"))


PHRASES = "ph AS (SELECT DISTINCT trim(s) AS phrase FROM (SELECT unnest(string_split(category, '/')) AS s FROM items) WHERE trim(s) NOT IN ('', 'unknown'))"
TRUSTED = f"""{PHRASES}, pw AS (SELECT DISTINCT unnest({tok('phrase')}) AS w FROM ph), bc AS (SELECT brand, count(*) AS n FROM items WHERE brand <> 'unknown' GROUP BY 1),
  tb AS (SELECT brand, n FROM bc WHERE contains(brand, ' ') OR (n >= 3 AND length(brand) > 2 AND brand NOT IN ({quoted([*L.GENDER_WORDS, *L.AGE_WORDS, *L.COLOURS, *L.MATERIAL])}) AND brand NOT IN (SELECT w FROM pw)))"""


@query(f"WITH {TRUSTED} SELECT brand, n FROM tb")
def trusted_brand_dictionary(t):
    return dictionary.trusted_brands(t.items)


GRAMS = f"""gt AS (SELECT term_id, query, {tok('query')} AS ws FROM terms), gg AS (SELECT term_id, unnest(list_concat(ws, list_concat([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))], [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]))) AS g,
  unnest(range(len(list_concat(ws, list_concat([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))], [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]))))) AS i FROM gt)"""


@query(f"""WITH {TRUSTED}, {GRAMS}, qb AS (SELECT term_id, g AS qbrand FROM gg JOIN tb ON g = brand QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY length(g) DESC, i) = 1), qc AS (SELECT term_id, g AS qcat FROM gg JOIN ph ON g = phrase QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY length(g) DESC, i) = 1)
  SELECT term_id, qbrand, qcat, CASE WHEN qbrand = query THEN 'brand_only' WHEN qbrand IS NOT NULL AND qcat IS NOT NULL THEN 'brand_category' WHEN qbrand IS NOT NULL THEN 'brand_other' WHEN qcat = query THEN 'category_only' WHEN qcat IS NOT NULL THEN 'category_attr' ELSE 'other' END AS query_type
  FROM terms LEFT JOIN qb USING (term_id) LEFT JOIN qc USING (term_id)""")
def ngram_dictionary_join(t):
    return _phrases(t).select("term_id", "qbrand", "qcat", signals.query_type(c("query"), c("qbrand"), c("qcat")).alias("query_type"))


def _phrases(t):
    b = dictionary.longest_phrase(t.terms, dictionary.trusted_brands(t.items), "brand", "qbrand")
    p = dictionary.longest_phrase(t.terms, dictionary.category_phrases(t.items), "phrase", "qcat")
    return t.terms.join(b, "term_id", "left").join(p, "term_id", "left")


@query(f"""WITH {TRUSTED}, {GRAMS}, qb AS (SELECT term_id, g AS qbrand FROM gg JOIN tb ON g = brand QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY length(g) DESC, i) = 1), qc AS (SELECT term_id, g AS qcat FROM gg JOIN ph ON g = phrase QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY length(g) DESC, i) = 1)
  SELECT term_id, item_id, CAST(CASE WHEN qbrand IS NULL THEN 0 WHEN brand <> 'unknown' AND (contains(brand, qbrand) OR contains(qbrand, brand)) THEN 1 ELSE -1 END AS DOUBLE) AS trusted_brand, CAST(CASE WHEN qcat IS NULL THEN 0 WHEN contains(category, qcat) THEN 1 ELSE -1 END AS DOUBLE) AS category_phrase
  FROM pairs JOIN items USING (item_id) LEFT JOIN qb USING (term_id) LEFT JOIN qc USING (term_id)""")
def phrase_signals(t):
    p = t.pairs.join(_phrases(t), "term_id").join(t.items, "item_id")
    return p.select("term_id", "item_id", signals.phrase_signal(c("qbrand"), c("brand"), True).alias("trusted_brand"), signals.phrase_signal(c("qcat"), c("category"), False).alias("category_phrase"))


QW = f"[w FOR w IN {tok('query')} IF w NOT IN ({quoted(L.STOP_QUERY)}) AND length(w) >= 3]"
BRANDS = f"""bw AS (SELECT term_id, unnest({QW}) AS token FROM terms WHERE term_id IN (SELECT term_id FROM pairs)), tot AS (SELECT token, count(*) AS n_queries FROM bw GROUP BY 1), tbr AS (SELECT DISTINCT term_id, {tok('brand')}[1] AS brand FROM pairs JOIN items USING (item_id) WHERE {tok('brand')}[1] NOT IN ('', 'nan')),
  cnt AS (SELECT token, brand, count(*) AS n FROM bw JOIN tbr USING (term_id) GROUP BY 1, 2), best AS (SELECT * FROM cnt QUALIFY row_number() OVER (PARTITION BY token ORDER BY n DESC, brand) = 1),
  bd AS (SELECT token, brand, CAST(n AS DOUBLE) / n_queries AS confidence, n_queries FROM best JOIN tot USING (token) WHERE CAST(n AS DOUBLE) / n_queries >= 0.7 AND n_queries >= 3)"""


@query(f"WITH {BRANDS} SELECT token, brand, round(confidence, 9) AS confidence, n_queries FROM bd")
def learned_brand_dictionary(t):
    d = dictionary.brand_dictionary(t.pairs, t.terms, t.items)
    return d.select("token", "brand", F.round("confidence", 9).alias("confidence"), "n_queries")


def size_sql() -> str:
    end = f"(?:$|[^{LETTERS}])"
    one = lambda pattern, unit: f"[x || '{unit}' FOR x IN regexp_extract_all(' ' || replace(normalized, ' ', '  ') || ' ', '{pattern}', 1)]"
    parts = [one(rf"[^{LETTERS}](\d+(?:\.\d+)?)\s*{w}{end}", u) for w, u in L.UNITS]
    parts += [one(rf"[^{LETTERS}](\d+)\s*numara{end}", "numara"), one(rf"[^{LETTERS}]no[\s.]?(\d+){end}", "numara"), one(rf"[^{LETTERS}]({'|'.join(L.GARMENT_SIZES)}){end}", "tekstil_beden")]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


@query(f"""WITH {BRANDS}, n AS (SELECT term_id, query, {LOWER.format('query')} AS normalized FROM terms), k AS (SELECT *, {tok('normalized')} AS ws FROM n), hx AS (SELECT term_id, unnest(ws) AS token, unnest(range(len(ws))) AS i FROM k),
  hb AS (SELECT term_id, token, brand, confidence FROM hx JOIN bd USING (token) QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY confidence DESC, i) = 1)
  SELECT term_id, query, normalized, brand, coalesce(round(confidence, 3), 0.0) AS brand_conf, CASE {has('ws', L.PARSE_GENDER)}[-1] {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in L.PARSE_GENDER.items())} END AS gender,
  CASE {has('ws', L.PARSE_AGE)}[-1] {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in L.PARSE_AGE.items())} END AS age_range, array_to_string({has('ws', L.PARSE_COLOURS)}, '|') AS colors, array_to_string({size_sql()}, '|') AS sizes, array_to_string({has('ws', L.PARSE_MATERIALS)}, '|') AS materials,
  array_to_string([w FOR w IN ws IF w NOT IN ({quoted([*L.PARSE_COLOURS, *L.PARSE_MATERIALS, *L.PARSE_GENDER, *L.PARSE_AGE, *L.STOP_QUERY])}) AND length(w) >= 3 AND NOT regexp_matches(w, '^[0-9]') AND w IS DISTINCT FROM hb.token], ' ') AS product_tokens FROM k LEFT JOIN hb USING (term_id)""")
def parse_query(t):
    return parse.parse(t.terms, dictionary.brand_dictionary(t.pairs, t.terms, t.items))


SPAN = f"""sb AS (SELECT DISTINCT brand FROM items WHERE brand NOT IN ('', 'unknown')), ft AS (SELECT w FROM (SELECT unnest({tok('brand')}) AS w FROM sb) WHERE length(w) >= 4 GROUP BY 1 HAVING count(*) >= 5), sw AS (SELECT term_id, {tok('query')} AS ws FROM terms),
  sp AS (SELECT term_id, n, s, array_to_string(ws[s + 1:s + n], ' ') AS g FROM sw, range(1, 6) a(n), range(0, 20) b(s) WHERE s + n <= len(ws)), hit AS (SELECT term_id, n, s, g, 'exact' AS method FROM sp JOIN sb ON g = brand UNION ALL SELECT term_id, n, s, g, 'token' FROM sp JOIN ft ON g = w WHERE n = 1),
  top AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY method, n DESC, s) = 1),
  spans AS (SELECT term_id, g AS brand_found, CAST(s AS INT) AS brand_pos, CAST(coalesce(n, 0) AS INT) AS brand_len, coalesce(method, 'none') AS method, CASE WHEN s IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(list_concat(ws[1:s], ws[s + n + 1:]), ' ') END AS product_part FROM sw LEFT JOIN top USING (term_id))"""


@query(f"WITH {SPAN} SELECT * FROM spans")
def span_brand_detection(t):
    return parse.brand_span(t.terms, t.items)


VOCAB = f"pv AS (SELECT w FROM (SELECT unnest({tok("replace(category, '/', ' ')")}) AS w FROM items) WHERE length(w) >= 3 GROUP BY 1 HAVING count(*) >= 20), pvs AS (SELECT DISTINCT {STEM.format('w')} AS s FROM pv)"
SPEC = f"sx AS (SELECT term_id, unnest({tok('product_part')}) AS w FROM spans), sn AS (SELECT term_id, count(*) AS n FROM sx WHERE w IN (SELECT w FROM pv) OR {STEM.format('w')} IN (SELECT s FROM pvs) GROUP BY 1), spec AS (SELECT term_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matched, CASE WHEN product_part = '' THEN 'soyut' WHEN coalesce(n, 0) = 0 THEN 'belirsiz' WHEN n = 1 THEN 'kategori' ELSE 'spesifik' END AS specificity FROM spans LEFT JOIN sn USING (term_id))"


@query(f"WITH {SPAN}, {VOCAB}, {SPEC} SELECT * FROM spec")
def product_specificity(t):
    return parse.specificity(parse.brand_span(t.terms, t.items), t.items, 20)


def listed(ws) -> str:
    return f"array_to_string(list_sort(list_distinct({has(tok('query'), ws)})), '|')"


@query(f"""WITH {SPAN}, {VOCAB}, {SPEC}, d AS (SELECT term_id, CASE WHEN contains(query, 'erkek çocuk') OR contains(query, 'erkekçocuk') THEN 'erkek_çocuk' WHEN contains(query, 'kız çocuk') OR contains(query, 'kızçocuk') THEN 'kız_çocuk' WHEN {word('query', 'kadın', 'bayan')} THEN 'kadın' WHEN {word('query', 'kız')} THEN 'kız_çocuk' WHEN {word('query', 'erkek')} THEN 'erkek' WHEN {word('query', 'unisex')} THEN 'unisex' END AS gender,
   CASE WHEN {word('query', 'bebek', 'infant')} THEN 'bebek' WHEN {word('query', 'çocuk', 'kids', 'junior')} THEN 'çocuk' WHEN {word('query', 'genç')} THEN 'genç' WHEN {word('query', 'yetişkin')} THEN 'yetişkin' END AS age, {listed(L.LIST_COLOURS)} AS attr_colour, {listed(L.LIST_SIZES)} AS attr_size, {listed(L.LIST_MATERIALS)} AS attr_material, {listed(L.LIST_STYLES)} AS attr_style FROM terms)
  SELECT term_id, gender, age, attr_colour, attr_size, attr_material, attr_style, CASE WHEN k = '' THEN 'BELİRSİZ' ELSE k END AS query_type_full FROM (SELECT *, concat_ws(' + ', CASE WHEN method <> 'none' THEN 'MARKA' END, 'CİNS(' || gender || ')', 'YAŞ(' || age || ')', CASE WHEN attr_colour <> '' THEN 'RENK' END, CASE WHEN attr_size <> '' THEN 'BEDEN' END, CASE specificity WHEN 'spesifik' THEN 'ÜRÜN↑' WHEN 'kategori' THEN 'ÜRÜN' END) AS k FROM d JOIN spans USING (term_id) JOIN spec USING (term_id))""")
def composite_query_type(t):
    spans = parse.brand_span(t.terms, t.items)
    spec = parse.specificity(spans, t.items, 20)
    gender, age = parse.demographics(c("query"))
    d = t.terms.select("term_id", gender.alias("gender"), age.alias("age"), *parse.attribute_lists(c("query")))
    j = d.join(spans, "term_id").join(spec, "term_id")
    return j.select("term_id", "gender", "age", "attr_colour", "attr_size", "attr_material", "attr_style", parse.composite_type(c("method"), c("gender"), c("age"), c("attr_colour"), c("attr_size"), c("specificity")).alias("query_type_full"))


def vote_sql(value: str, k: int, normalised: bool) -> str:
    w = "CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY token)" if normalised else "CAST(n AS DOUBLE)"
    return f"""WITH vw AS (SELECT term_id, unnest(list_distinct({QW})) AS token FROM terms), vc AS (SELECT token, {value} AS value, count(*) AS n FROM vw JOIN pairs USING (term_id) JOIN items USING (item_id) GROUP BY 1, 2), vn AS (SELECT token, value, {w} AS w FROM vc),
  g AS (SELECT term_id, value, sum(w) AS votes FROM vw JOIN vn USING (token) GROUP BY 1, 2) SELECT term_id, value, round(votes, 6) AS votes, round(votes / sum(votes) OVER (PARTITION BY term_id), 6) AS share, CAST(row_number() OVER (PARTITION BY term_id ORDER BY round(votes, 9) DESC, value) AS INT) AS rank FROM g QUALIFY rank <= {k}"""


def _vote(t, value, k, normalised):
    got = dictionary.vote(t.terms, dictionary.votes(t.pairs, t.terms, t.items, value), k, normalised)
    return got.select("term_id", "value", F.round("votes", 6).alias("votes"), F.round("share", 6).alias("share"), "rank")


@query(vote_sql("string_split(category, '/')[1]", 2, True))
def category_vote_topk(t):
    return _vote(t, F.get(F.split("category", "/"), 0), 2, True)


@query(vote_sql("brand", 3, False))
def brand_vote_topk(t):
    return _vote(t, c("brand"), 3, False)


# --- weights ------------------------------------------------------------------------------------------------------------

WORDS = "regexp_extract_all(lower({}), '" + weights.WORD.replace("{", "{{").replace("}", "}}") + "')"


@query(f"WITH d AS (SELECT doc_id, unnest(list_distinct({WORDS.format('text')})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df, round(ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1), 9) AS idf FROM d, n GROUP BY term, n HAVING count(*) >= 5", adapters=False)
def idf_table(t):
    return weights.idf_sets(t.documents, "doc_id", weights.words(c("text"))).filter("df >= 5").select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"""WITH d AS (SELECT doc_id, unnest(list_distinct({WORDS.format('text')})) AS term FROM documents), idf AS (SELECT term, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM d GROUP BY 1), q AS (SELECT item_id, unnest({WORDS.format('text')}) AS term FROM benchmark)
  SELECT item_id, count(*) AS n, round(sum(idf), 6) AS weight FROM q JOIN idf USING (term) GROUP BY 1""", adapters=False)
def idf_overlap(t):
    idf = weights.idf_sets(t.documents, "doc_id", weights.words(c("text")))
    return t.benchmark.select("item_id", F.explode(weights.words(c("text"))).alias("term")).join(idf, "term").groupBy("item_id").agg(F.count("*").alias("n"), F.round(F.sum("idf"), 6).alias("weight"))


TFIDF = f"""tf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({WORDS.format('title')}) AS term FROM items) GROUP BY 1, 2), dfx AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2), idf AS (SELECT term, ln((1 + (SELECT count(*) FROM items)) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM dfx),
  iw0 AS (SELECT item_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)), iw AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM iw0), qf AS (SELECT term_id, term, count(*) AS tf FROM (SELECT term_id, unnest({WORDS.format('query')}) AS term FROM terms) GROUP BY 1, 2),
  qw0 AS (SELECT term_id, term, (1 + ln(tf)) * idf AS w FROM qf JOIN idf USING (term)), qw AS (SELECT term_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY term_id)) AS w FROM qw0)"""


def _tfidf(t):
    items = t.items.select("item_id", weights.words(c("title")).alias("ws"))
    terms = t.terms.select("term_id", weights.words(c("query")).alias("ws"))
    iw = weights.tfidf(items, items, "item_id", c("ws"))
    n = terms.select(c("term_id"), c("ws"))
    tf = items.withColumnRenamed("item_id", "_k")
    qw = weights.tfidf(tf, n.withColumnRenamed("term_id", "_k"), "_k", c("ws")).withColumnRenamed("_k", "term_id")
    return iw, qw


@query(f"WITH {TFIDF} SELECT term_id, item_id, round(sum(qw.w * iw.w), 6) AS score FROM pairs JOIN qw USING (term_id) JOIN iw USING (item_id, term) GROUP BY 1, 2")
def tfidf_cosine(t):
    iw, qw = _tfidf(t)
    p = t.pairs.join(qw.withColumnRenamed("w", "_q"), "term_id").join(iw.withColumnRenamed("w", "_i"), ["item_id", "term"])
    return p.groupBy("term_id", "item_id").agg(F.round(F.sum(c("_q") * c("_i")), 6).alias("score"))


@query(f"WITH {TFIDF}, s AS (SELECT term_id, item_id, round(sum(qw.w * iw.w), 6) AS score FROM qw JOIN iw USING (term) GROUP BY 1, 2) SELECT term_id, item_id, score, CAST(row_number() OVER (PARTITION BY term_id ORDER BY score DESC, item_id) AS INT) AS rank FROM s QUALIFY rank <= 10")
def tfidf_retrieval_topk(t):
    return nearest_titles(t.terms, t, 10)


def nearest_titles(asks, t, k: int, search=nearest.nearest):
    """The k nearest titles of every query of ``asks``."""
    return search(asks, t.items, "term_id", "item_id", weights.words(c("query")), weights.words(c("title")), k)


@query(f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents) GROUP BY 1, 2), ln_ AS (SELECT doc_id, len({WORDS.format('text')}) AS n FROM documents), st AS (SELECT count(*) AS n, avg(n) AS mean FROM ln_), raw AS (SELECT term, ln((SELECT n FROM st) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf GROUP BY 1),
  idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw), q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({WORDS.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
  s AS (SELECT item_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / (SELECT mean FROM st)))), 6) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN ln_ USING (doc_id) GROUP BY 1, 2) SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s QUALIFY rank <= 5""", adapters=False)
def bm25_topk(t):
    docs = t.documents.select("doc_id", weights.words(c("text")).alias("ws"))
    asks = t.benchmark.select("item_id", weights.words(c("text")).alias("qs"))
    s = weights.bm25(docs, asks, "doc_id", "item_id", c("ws"), c("qs")).withColumn("score", F.round("score", 6))
    return relational.top_k(s, "item_id", 5, c("score").desc(), c("doc_id")).select("item_id", "doc_id", "score", "rank")


@query(f"""WITH v AS (SELECT term FROM (SELECT unnest({tok('title')}) AS term FROM items) GROUP BY 1 HAVING count(*) >= 5), {PAIR}, g AS (SELECT term_id, item_id, list_distinct(list_concat(q, [q[i] || ' ' || q[i + 1] FOR i IN range(1, len(q))])) AS a, list_distinct(list_concat(tt, [tt[i] || ' ' || tt[i + 1] FOR i IN range(1, len(tt))])) AS b FROM pp),
  k AS (SELECT term_id, item_id, list_intersect(a, (SELECT list(term) FROM v)) AS a, list_intersect(b, (SELECT list(term) FROM v)) AS b FROM g)
  SELECT term_id * 1000000 + item_id AS pair, CAST(len(list_intersect(a, b)) AS BIGINT) AS n, round(len(list_intersect(a, b)) / (len(a) + 1e-6), 9) AS ratio, round(len(list_intersect(a, b)) / (len(list_distinct(list_concat(a, b))) + 1e-6), 9) AS jaccard FROM k""")
def vocabulary_ngram_overlap(t):
    v = t.items.select(F.explode(text.tokens(c("title"))).alias("term")).groupBy("term").count().filter("count >= 5").select("term")
    p = t.pairs.join(t.terms, "term_id").join(t.items, "item_id").withColumn("pair", c("term_id") * 1000000 + c("item_id"))
    return weights.vocabulary_overlap(p, c("query"), c("title"), v, "pair").select("pair", "n", F.round("ratio", 9).alias("ratio"), F.round("jaccard", 9).alias("jaccard"))


@query(f"""WITH {PAIR} SELECT term_id, item_id, CAST(length(brand) >= 3 AND brand <> 'unknown' AND contains(query, brand) AS DOUBLE) AS brand_in_query, CAST(length(brand) >= 3 AND len([w FOR w IN q IF length(w) >= 3 AND (contains(w, brand) OR contains(brand, w))]) > 0 AS DOUBLE) AS brand_either,
  CASE WHEN (contains(query, 'kadın') AND contains(gender, 'kadın')) OR (contains(query, 'erkek') AND contains(gender, 'erkek')) THEN 1 ELSE 0 END AS gender_match, CASE WHEN (contains(query, 'kadın') AND contains(gender, 'erkek')) OR (contains(query, 'erkek') AND contains(gender, 'kadın')) THEN 1 ELSE 0 END AS gender_conflict FROM pp""")
def containment_features(t):
    match, conflict = signals.gender_flags(c("query"), c("gender"))
    return per_pair(t).select("term_id", "item_id", similarity.contains_known(c("query"), c("brand"), 3).alias("brand_in_query"), similarity.either_contains(c("brand"), c("q")).alias("brand_either"), match.alias("gender_match"), conflict.alias("gender_conflict"))


@query()
def fuzzy_ratios(t):
    p = t.pairs.join(t.terms, "term_id").join(t.items, "item_id").select("query", "title").distinct()
    return p.select("query", "title", similarity.fuzzy(c("query"), c("title")).alias("f")).select("query", "title", "f.*")
