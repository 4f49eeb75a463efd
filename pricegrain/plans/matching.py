"""Entity resolution over the parts as offers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricegrain.functions import similarity, text
from pricegrain.operators import extract, graph, index, market, rematch, resolve, storage
from pricegrain.plans.base import table
from pricegrain.plans.registry import query

_C = """WITH c AS (SELECT p_partkey AS id, p_brand AS game, CASE WHEN p_size % 4 <> 0 THEN p_type END AS set_code, CASE WHEN p_size % 5 <> 0 THEN split_part(p_name, ' ', 1) END AS product_type,
  string_split(p_name, ' ') AS tokens, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ' ') AS name_key FROM part),
t AS (SELECT id, unnest(list_distinct(tokens)) AS token FROM c), n AS (SELECT count(*) AS n FROM c), idf AS (SELECT token, count(*) AS df, ln((any_value(n.n) + 1.0) / (count(*) + 1)) + 1 AS idf FROM t, n GROUP BY token)"""
_OK = "coalesce(a.game = b.game, true) AND coalesce(a.set_code = b.set_code, true) AND coalesce(a.product_type = b.product_type, true)"


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    tokens = F.split("p_name", " ")
    none = F.array().cast("array<string>")
    return p.select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("part::"), F.col("p_partkey").cast("string")).alias("stable_key"), F.col("p_brand").alias("game"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("set_code"), F.when(F.col("p_size") % 5 != 0, F.substring_index("p_name", " ", 1)).alias("product_type"),
        F.when(F.col("p_size") % 7 == 0, "es").when(F.col("p_size") % 7 == 1, "en").alias("language"), F.col("p_size").alias("units_total"),
        F.when(F.col("p_size") % 2 == 0, 0.9).otherwise(0.5).alias("quantity_confidence"), F.array_join(F.array_sort(F.array_distinct(tokens)), " ").alias("name_key"), F.col("p_name").alias("name"), tokens.alias("tokens"),
        F.when(F.col("p_partkey") % 50 < 2, F.array(F.lpad(F.floor(F.col("p_partkey") / 50).cast("string"), 14, "0"))).otherwise(none).alias("gtins"),
        F.when(F.col("p_partkey") % 70 < 2, F.array(F.concat(F.lit("M"), F.floor(F.col("p_partkey") / 70).cast("string")))).otherwise(none).alias("mpns"),
    )


@query(_C + " SELECT token, df, round(idf, 9) AS idf FROM idf")
def token_idf(spark: SparkSession, sf: str) -> DataFrame:
    return market.inverse_document_frequency(candidates(spark, sf), "id", "tokens")[0].withColumn("idf", F.round("idf", 9))


@query(_C + f""", k AS (SELECT id, game, set_code, product_type, 'type' || chr(1) || game || chr(1) || set_code || chr(1) || coalesce(product_type, chr(2)) AS key FROM c WHERE set_code IS NOT NULL
  UNION ALL SELECT id, game, set_code, product_type, 'set' || chr(1) || game || chr(1) || set_code FROM c WHERE set_code IS NOT NULL UNION ALL SELECT id, game, set_code, product_type, 'name' || chr(1) || name_key FROM c),
g AS (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 300), m AS (SELECT k.* FROM k JOIN g USING (key))
SELECT DISTINCT a.id AS a, b.id AS b FROM m a JOIN m b ON a.key = b.key AND a.id < b.id AND {_OK}""")
def block_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.block_pairs(candidates(spark, sf))


@query(_C + f""", u AS (SELECT t.id, t.token, idf FROM t JOIN idf USING (token), n WHERE df >= 2 AND df <= 400 AND (df <= 60 OR df <= 0.25 * n.n)),
s AS (SELECT a.id, b.id AS other, sum(a.idf) AS w FROM u a JOIN u b ON a.token = b.token AND a.id <> b.id GROUP BY ALL), r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(w, 9) DESC, other) <= 80),
p AS (SELECT DISTINCT least(id, other) AS x, greatest(id, other) AS y FROM r)
SELECT x AS a, y AS b FROM p JOIN c a ON a.id = x JOIN c b ON b.id = y WHERE {_OK}""")
def token_blocking(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.rare_token_pairs(candidates(spark, sf))


@query(_C + """, f AS (SELECT id, token, count(*) / any_value(len(tokens)) AS tf FROM (SELECT id, tokens, unnest(tokens) AS token FROM c) GROUP BY id, token), w AS (SELECT id, token, tf * idf AS w FROM f JOIN idf USING (token)),
v AS (SELECT id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w), k AS (SELECT id, game, set_code FROM c WHERE set_code IS NOT NULL)
SELECT x.id AS a, y.id AS b, round(coalesce((SELECT sum(p.w * q.w) FROM v p JOIN v q ON p.token = q.token WHERE p.id = x.id AND q.id = y.id), 0), 6) AS cosine FROM k x JOIN k y ON x.game = y.game AND x.set_code = y.set_code AND x.id < y.id""")
def tfidf_cosine(spark: SparkSession, sf: str) -> DataFrame:
    key = F.when(F.col("game").isNotNull() & F.col("set_code").isNotNull(), F.array("game", "set_code"))
    return resolve.pair_cosines(candidates(spark, sf).select("id", key.alias("key"), "tokens"))


@query()
def pair_score(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(spark, sf)
    stats = resolve.token_stats(c)
    return resolve.score_pairs(c, resolve.candidate_pairs(c, stats=stats), stats=stats)


_SCORES = _C + f""",
k AS (SELECT id, game, set_code, product_type, 'type' || chr(1) || game || chr(1) || set_code || chr(1) || coalesce(product_type, chr(2)) AS key FROM c WHERE set_code IS NOT NULL
  UNION ALL SELECT id, game, set_code, product_type, 'set' || chr(1) || game || chr(1) || set_code FROM c WHERE set_code IS NOT NULL UNION ALL SELECT id, game, set_code, product_type, 'name' || chr(1) || name_key FROM c),
g AS (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 300), m AS (SELECT k.* FROM k JOIN g USING (key)),
u AS (SELECT t.id, t.token, idf FROM t JOIN idf USING (token), n WHERE df >= 2 AND df <= 400 AND (df <= 60 OR df <= 0.25 * n.n)),
sh AS (SELECT a.id, b.id AS other, sum(a.idf) AS w FROM u a JOIN u b ON a.token = b.token AND a.id <> b.id GROUP BY ALL), r AS (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(w, 9) DESC, other) <= 80),
pt AS (SELECT DISTINCT least(id, other) AS x, greatest(id, other) AS y FROM r),
pairs AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON a.key = b.key AND a.id < b.id AND {_OK} UNION SELECT x, y FROM pt JOIN c a ON a.id = x JOIN c b ON b.id = y WHERE {_OK}),
own AS (SELECT c.*, array_to_string(tokens, ' ') AS name, CASE p_size % 7 WHEN 0 THEN 'es' WHEN 1 THEN 'en' END AS language, CASE WHEN p_size % 2 = 0 THEN p_size END AS q, CASE WHEN id % 50 < 2 THEN id // 50 END AS gtin, CASE WHEN id % 70 < 2 THEN id // 70 END AS mpn,
  (SELECT list(t.token) FROM t JOIN idf USING (token), n WHERE t.id = c.id AND df <= 0.02 * n.n) AS rare FROM c JOIN part ON p_partkey = id),
f AS (SELECT id, token, count(*) / any_value(len(tokens)) AS tf FROM (SELECT id, tokens, unnest(tokens) AS token FROM c) GROUP BY id, token), w AS (SELECT id, token, tf * idf AS w FROM f JOIN idf USING (token)),
v AS (SELECT id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w),
cos AS (SELECT a, b, sum(p.w * q.w) AS cosine FROM pairs JOIN v p ON p.id = a JOIN v q ON q.id = b AND q.token = p.token GROUP BY a, b),
j AS (SELECT a, b, x.tokens AS xt, y.tokens AS yt, x.name AS xn, y.name AS yn, coalesce(x.gtin = y.gtin, false) AS same_gtin, coalesce(x.mpn = y.mpn, false) AS same_mpn, x.q AS qa, y.q AS qb, coalesce(cosine, 0) AS cosine, x.name_key = y.name_key AND x.name_key <> '' AS by_name,
    coalesce(x.game <> y.game, false) OR coalesce(x.set_code <> y.set_code, false) OR coalesce(x.product_type <> y.product_type, false) OR coalesce(x.language <> y.language, false) AS reject,
    len(list_intersect(x.tokens, y.tokens)) / len(list_distinct(list_concat(x.tokens, y.tokens))) AS jac, coalesce(x.set_code = y.set_code, false) AS same_set, coalesce(x.product_type = y.product_type, false) AS same_type,
    x.set_code IS NULL AND y.set_code IS NULL AND x.product_type IS NULL AND y.product_type IS NULL AS bare, coalesce(x.q <> y.q, false) AS unequal,
    CASE WHEN x.set_code IS NOT NULL AND y.set_code IS NOT NULL THEN 20 WHEN x.set_code IS NOT NULL OR y.set_code IS NOT NULL THEN 7 ELSE 0 END AS e1, CASE WHEN x.product_type IS NOT NULL AND y.product_type IS NOT NULL THEN 25 WHEN x.product_type IS NOT NULL OR y.product_type IS NOT NULL THEN 8.75 ELSE 0 END AS e2,
    CASE WHEN x.q <> y.q THEN 0 WHEN x.q IS NOT NULL AND y.q IS NOT NULL THEN 15 WHEN x.q IS NOT NULL OR y.q IS NOT NULL THEN 5.25 ELSE 0 END AS e3, CASE WHEN x.language = y.language THEN 5 ELSE 0 END AS e4,
    CASE WHEN x.set_code IS NOT NULL OR y.set_code IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN x.product_type IS NOT NULL OR y.product_type IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN x.q IS NOT NULL OR y.q IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN x.language IS NOT NULL AND y.language IS NOT NULL THEN 5 ELSE 0 END AS applicable,
    len(list_filter(list_distinct(x.tokens), lambda i: NOT list_contains(y.tokens, i) AND (contains(i, '_') OR regexp_full_match(i, '[A-Za-z]') OR coalesce(list_contains(x.rare, i), false)))) + len(list_filter(list_distinct(y.tokens), lambda i: NOT list_contains(x.tokens, i) AND (contains(i, '_') OR regexp_full_match(i, '[A-Za-z]') OR coalesce(list_contains(y.rare, i), false)))) AS telling
  FROM pairs JOIN own x ON x.id = a JOIN own y ON y.id = b LEFT JOIN cos USING (a, b)),
e AS (SELECT *, (e1 + e2 + e3 + e4)::DOUBLE AS earned, CASE WHEN unequal THEN -30 ELSE 0 END AS penalty, list_sort(list_intersect(xt, yt)) AS common, list_sort(list_filter(list_distinct(xt), lambda i: NOT list_contains(yt, i))) AS rx, list_sort(list_filter(list_distinct(yt), lambda i: NOT list_contains(xt, i))) AS ry FROM j),
h AS (SELECT *, 100 * (earned + 20 * jac + 20) / (applicable + 40) + penalty AS bound, array_to_string(common, ' ') AS cs, array_to_string(list_concat(common, rx), ' ') AS l, array_to_string(list_concat(common, ry), ' ') AS rr, array_to_string(list_sort(xt), ' ') AS sx, array_to_string(list_sort(yt), ' ') AS sy FROM e),
z AS (SELECT *, 0.30 * greatest(1 - levenshtein(cs, l) / greatest(length(cs), length(l)), 1 - levenshtein(cs, rr) / greatest(length(cs), length(rr)), 1 - levenshtein(l, rr) / greatest(length(l), length(rr))) + 0.25 * cosine
    + 0.20 * (1 - levenshtein(sx, sy) / greatest(length(sx), length(sy))) + 0.15 * jaro_winkler_similarity(xn, yn) + 0.10 * (1 - levenshtein(xn, yn) / greatest(length(xn), length(yn))) AS combined FROM h),
raw1 AS (SELECT *, 100 * (earned + 20 * jac + 20 * combined) / (applicable + 40) + penalty + greatest(-42, -14 * telling) AS r1 FROM z),
raw2 AS (SELECT *, CASE WHEN same_mpn THEN greatest(r1, 95) ELSE r1 END AS r2 FROM raw1), raw3 AS (SELECT *, greatest(0, least(100, CASE WHEN bare AND NOT by_name THEN least(r2, 88) ELSE r2 END)) AS r3 FROM raw2)
SELECT a, b, round(CASE WHEN same_gtin THEN 100 WHEN reject THEN 0 WHEN NOT same_mpn AND bound < 75 THEN greatest(0, bound) WHEN NOT same_mpn AND by_name THEN greatest(r3, 95) ELSE r3 END, 2) AS score,
  CASE WHEN same_gtin THEN 'EAN_MATCH' WHEN reject OR NOT same_mpn AND bound < 75 THEN 'FUZZY_MATCH' WHEN same_mpn THEN 'SKU_MATCH' WHEN by_name THEN 'NAME_MATCH' WHEN same_set AND same_type AND qa IS NOT DISTINCT FROM qb THEN 'ATTRIBUTE_MATCH' ELSE 'FUZZY_MATCH' END AS method FROM raw3"""


@query(_SCORES)
def pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate pair's score and method, without the breakdown."""
    return pair_score(spark, sf).select("a", "b", "score", "method")


def _decisions(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Neighbours by id: same at every 40th, different at every 60th."""
    step = 40 if kind == "same" else 60
    return table(spark, sf, "part").filter(F.col("p_partkey") % step == 3).select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))


def _grouped(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = candidates(spark, sf)
    stats = resolve.token_stats(c)
    scored = resolve.written(resolve.score_pairs(c, resolve.candidate_pairs(c, stats=stats), stats=stats).filter("score >= 75"), "scored")
    return resolve.group(c, scored, _decisions(spark, sf, "same"), _decisions(spark, sf, "different"))


# one edge after another, in the greedy order; the group of every offer goes along as a list
_GROUPS = _SCORES.replace("WITH", "WITH RECURSIVE", 1).replace("\nSELECT a, b, round(CASE WHEN same_gtin", ",\nsc AS (SELECT a, b, round(CASE WHEN same_gtin", 1) + """),
same AS (SELECT id AS a, id + 1 AS b FROM c WHERE id % 40 = 3 AND id + 1 IN (SELECT id FROM c)), diff AS (SELECT id AS a, id + 1 AS b FROM c WHERE id % 60 = 3 AND id + 1 IN (SELECT id FROM c)),
anchors AS (SELECT gtin, min(id) AS a FROM own WHERE gtin IS NOT NULL GROUP BY 1),
edges AS (
  SELECT a, id AS b, 0 AS stage, 100.0::DOUBLE AS score, 'EAN_MATCH' AS method FROM anchors JOIN own USING (gtin) WHERE id <> a UNION ALL SELECT a, b, 1, 100.0, 'MANUAL' FROM same
  UNION ALL SELECT a, b, 2, score, method FROM sc WHERE score >= 90 AND (a, b) NOT IN (SELECT (a, b) FROM diff)),
place AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM c),
ordered AS (SELECT edges.*, x.i AS ia, y.i AS ib, row_number() OVER (ORDER BY stage, score DESC, a, b) AS n FROM edges JOIN place x ON x.id = a JOIN place y ON y.id = b),
facts AS (SELECT list(set_code ORDER BY id) AS sets, list(product_type ORDER BY id) AS types, list(language ORDER BY id) AS languages FROM own), apart AS (SELECT coalesce(list([x.i, y.i]), []) AS pairs FROM diff JOIN place x ON x.id = a JOIN place y ON y.id = b),
steps AS (
  SELECT 0::BIGINT AS n, (SELECT list(i ORDER BY i) FROM place) AS labels, false AS joined
  UNION ALL SELECT n, CASE WHEN ok THEN list_transform(labels, lambda l: CASE WHEN l = greatest(la, lb) THEN least(la, lb) ELSE l END) ELSE labels END, ok FROM (
    SELECT e.n, labels, labels[e.ia] AS la, labels[e.ib] AS lb, labels[e.ia] <> labels[e.ib]
      AND len(list_distinct(list_filter(sets, lambda v, i: labels[i] = labels[e.ia] OR labels[i] = labels[e.ib]))) < 2 AND len(list_distinct(list_filter(types, lambda v, i: labels[i] = labels[e.ia] OR labels[i] = labels[e.ib]))) < 2
      AND len(list_distinct(list_filter(languages, lambda v, i: labels[i] = labels[e.ia] OR labels[i] = labels[e.ib]))) < 2
      AND len(list_filter(pairs, lambda d: labels[d[1]] <> labels[d[2]] AND (labels[d[1]] = labels[e.ia] OR labels[d[1]] = labels[e.ib]) AND (labels[d[2]] = labels[e.ia] OR labels[d[2]] = labels[e.ib]))) = 0 AS ok
    FROM steps s JOIN ordered e ON e.n = s.n + 1, facts, apart)),
final AS (SELECT p.id AS product_key, q.id FROM (SELECT unnest(labels) AS label, generate_subscripts(labels, 1) AS i FROM steps WHERE n = (SELECT max(n) FROM steps)) f JOIN place p ON p.i = label JOIN place q ON q.i = f.i),
made AS (SELECT o.* FROM ordered o JOIN steps USING (n) WHERE joined), ends AS (SELECT unnest([a, b]) AS id, * FROM made),
how AS (SELECT id, method, score FROM ends QUALIFY row_number() OVER (PARTITION BY id ORDER BY stage <> 1, n) = 1)"""


@query(_GROUPS + " SELECT id, product_key, coalesce(method, 'SINGLETON') AS method, coalesce(score, 100) AS score FROM final LEFT JOIN how USING (id)")
def clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _grouped(spark, sf)[0]


@query()
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    return _grouped(spark, sf)[1].orderBy(F.desc("score"), "a", "b")


@query()
def rematched(spark: SparkSession, sf: str) -> DataFrame:
    """Offers of every fiftieth part come with another size and language; the matching before is that without the change."""
    now = candidates(spark, sf)
    old = now.withColumns({"set_code": F.when(F.col("id") % 50 != 7, F.col("set_code")), "language": F.when(F.col("id") % 50 != 7, F.col("language")).otherwise("fr")}).filter("id % 200 <> 57")
    same, different = _decisions(spark, sf, "same"), _decisions(spark, sf, "different")
    stats = resolve.token_stats(old)
    found = rematch.rematch(rematch.match(old, same, different, stats), now, now.filter("id % 50 = 7").select("id"), same, different, stats)
    return found.assignment


@query(_GROUPS + " SELECT sc.a, sc.b, score, method FROM sc JOIN final x ON x.id = a JOIN final y ON y.id = b WHERE score >= 75 AND x.product_key <> y.product_key AND (a, b) NOT IN (SELECT (a, b) FROM diff)")
def review_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs that wait for a human, without the breakdown."""
    return review_queue(spark, sf).select("a", "b", "score", "method")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS a, lead(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_partkey) AS b FROM part QUALIFY b IS NOT NULL), s AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e), r AS (SELECT u AS node, u AS label FROM s UNION SELECT s.v, r.label FROM r JOIN s ON s.u = r.node)
SELECT node, min(label) AS component FROM r GROUP BY node""")
def decision_components(spark: SparkSession, sf: str) -> DataFrame:
    """Each part is decided to be the same as the next one of its brand, type and size."""
    after = F.lead("p_partkey").over(W.partitionBy("p_brand", "p_type", "p_size").orderBy("p_partkey"))
    e = table(spark, sf, "part").select(F.col("p_partkey").alias("a"), after.alias("b")).filter("b IS NOT NULL")
    return graph.min_labels(e)


@query("""WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) AS k, p_partkey AS product_id, p_type AS set_code, split_part(p_name, ' ', 1) AS product_type, CASE WHEN p_size % 3 = 0 THEN p_brand END AS language FROM part)
SELECT a.product_id AS p, b.product_id AS q, list_filter([CASE WHEN a.set_code <> b.set_code THEN 'set_code' END, CASE WHEN a.product_type <> b.product_type THEN 'product_type' END, CASE WHEN a.language <> b.language THEN 'language' END], lambda x: x IS NOT NULL) AS clashes,
  NOT coalesce(a.set_code <> b.set_code, false) AND NOT coalesce(a.product_type <> b.product_type, false) AND NOT coalesce(a.language <> b.language, false) AS allowed FROM p a JOIN p b ON b.product_id = a.product_id + 1""")
def merge_check(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("set_code"), F.substring_index("p_name", " ", 1).alias("product_type"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("language"))
    return resolve.merge_allowed(p, p.select(F.col("product_id").alias("p"), (F.col("product_id") + 1).alias("q")))


# the best answer of a name's tokens to each of the query's
_SCORED = """s AS (SELECT id, (SELECT list_sum(list_transform(asked, lambda q: list_max(list_transform(tokens, lambda t: CASE WHEN q = t THEN 1.0 WHEN starts_with(t, q) OR starts_with(q, t) THEN 0.9 WHEN contains(t, q) THEN 0.75
    WHEN jaro_winkler_similarity(q, t) > 0.88 THEN 0.7 * jaro_winkler_similarity(q, t) ELSE 0.0 END)))) / len(asked)) AS score FROM (SELECT p_partkey AS id, string_split(lower(p_name), ' ') AS tokens, ['smal', 'brass'] AS asked FROM part))"""


@query(f"WITH {_SCORED} SELECT p_partkey, p_name, round(score, 9) AS score FROM s JOIN part ON p_partkey = id WHERE round(score, 9) >= 0.45")
def search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """As search_score, by an index that is built on the way: Python sees tokens, not products."""
    p = table(spark, sf, "part")
    built = index.build(p, "p_partkey", F.split(F.lower("p_name"), " "), f"{storage.scratch(spark)}/index-{uuid.uuid4().hex}")
    return index.find(built, ["smal", "brass"], key="p_partkey").join(p.select("p_partkey", "p_name"), "p_partkey").select("p_partkey", "p_name", F.round("score", 9).alias("score"))


@query(f"WITH {_SCORED} SELECT p_partkey, p_name, round(score, 9) AS score FROM s JOIN part ON p_partkey = id WHERE round(score, 9) >= 0.45")
def search_score(spark: SparkSession, sf: str) -> DataFrame:
    """F8: products by their likeness to a misspelt query, from 0.45 on."""
    rows = table(spark, sf, "part").select("p_partkey", "p_name", F.round(similarity.search_score(F.array(F.lit("smal"), F.lit("brass")), F.split(F.lower("p_name"), " ")), 9).alias("score"))
    return rows.filter("score >= 0.45").orderBy(F.desc("score"), "p_partkey")


GOODS = extract.Catalog(
    games={"red": ("r", "Red line"), "blue": ("b", "Blue line")}, sets=[(r"\bsmall\b", "r", "sm", "Small", False), (r"\bold\b", "b", "ol", "Old", False), (r"\bnew\b", "r", "ne", "New", True)],
    types=[extract.ProductType("bolt", "Bolt", "bolt", 60, 12, 0.9), extract.ProductType("gear", "Gear", "gear", 50, 1, 0.8), extract.ProductType("box", "Box", "box", 40, 36, 0.95)],
    quantities=[(r"^lot of (\d+) ", "multiplier", 0.9), (r" (\d+) pieces$", "contents", 0.85), (r" times (\d+)$", "multiplier", 0.85)], blacklist=[45], most=60,
)


@query(r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'lot of ' || p_size || ' ' || p_name WHEN 1 THEN p_name || ' ' || p_size || ' pieces' WHEN 2 THEN p_name || ' times ' || p_size ELSE p_name END AS name, string_split(p_name, ' ') AS w, p_size AS n, p_partkey % 4 AS k FROM part),
g AS (SELECT *, CASE WHEN list_contains(w, 'red') THEN 'r' WHEN list_contains(w, 'blue') THEN 'b' END AS game, CASE WHEN list_contains(w, 'bolt') THEN 'bolt' WHEN list_contains(w, 'gear') THEN 'gear' WHEN list_contains(w, 'box') THEN 'box' END AS kind FROM t),
u AS (SELECT *, CASE kind WHEN 'bolt' THEN 12 WHEN 'gear' THEN 1 WHEN 'box' THEN 36 ELSE 0 END AS units, CASE kind WHEN 'bolt' THEN 0.9 WHEN 'gear' THEN 0.8 WHEN 'box' THEN 0.95 ELSE 0 END AS sure, k < 3 AND n <> 45 AND n <= 60 AS said, CASE k WHEN 0 THEN 0.9 ELSE 0.85 END AS c FROM g)
SELECT p_partkey, name, coalesce(game, CASE WHEN list_contains(w, 'small') THEN 'r' WHEN list_contains(w, 'old') THEN 'b' WHEN list_contains(w, 'new') THEN 'r' END) AS game,
  CASE WHEN list_contains(w, 'small') AND coalesce(game, 'r') = 'r' THEN 'sm' WHEN list_contains(w, 'old') AND coalesce(game, 'b') = 'b' THEN 'ol' WHEN list_contains(w, 'new') AND coalesce(game, 'r') = 'r' THEN 'ne' END AS set_code, kind AS product_type,
  CAST(CASE WHEN said AND k IN (0, 2) AND NOT (units > 1 AND n = units) THEN n ELSE 1 END AS INT) AS multiplier,
  CAST(CASE WHEN said AND k = 1 THEN n WHEN said AND units > 1 AND n = units THEN units WHEN said THEN n * greatest(units, 1) WHEN units > 0 THEN units END AS INT) AS units_total,
  CAST(CASE WHEN said AND k = 1 THEN 0.85 WHEN said AND units > 1 AND n = units THEN greatest(c, sure) WHEN said AND units > 0 THEN least(c, sure) WHEN said THEN c WHEN units > 0 THEN sure ELSE 0 END AS DOUBLE) AS confidence FROM u""")
def attributes(spark: SparkSession, sf: str) -> DataFrame:
    """E10-E15 over names that say a quantity in different ways."""
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    name = F.when(k == 0, F.concat_ws(" ", F.lit("lot of"), n, "p_name")).when(k == 1, F.concat_ws(" ", "p_name", n, F.lit("pieces"))).when(k == 2, F.concat_ws(" ", "p_name", F.lit("times"), n)).otherwise(F.col("p_name"))
    rules = text.NameRules()
    found = extract.extract(text.normalize_names(table(spark, sf, "part").select("p_partkey", name.alias("name")), "name", rules), GOODS, rules)
    a = F.col("attributes")
    return found.select("p_partkey", "name", a["game"].alias("game"), a["set_code"].alias("set_code"), a["product_type"].alias("product_type"), a["multiplier"].alias("multiplier"), a["units_total"].alias("units_total"), a["quantity_confidence"].alias("confidence"))
