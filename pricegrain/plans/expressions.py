"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.functions import money, parse, similarity, text
from pricegrain.plans.base import BASE, bare_offers, products, spread, table
from pricegrain.plans.registry import query

RULES = text.NameRules(
    replacements={"&": " and "}, noise=[r"\(pre-?order[^)]*\)"], phrases={"the of": "det_pair", "and the": "", "of the and": "det_triple"},
    stopwords=["the", "of", "and", "in"], protected=["in"], languages=[("strict", "en", r"\b(english|ingles)\b"), ("strict", "es", r"\b(spanish|espanol)\b"), ("delimited", "en", r"[\[(]en[\])]"), ("delimited", "es", r"[\[(]es[\])]"), ("loose", "en", r"\beng\b"), ("loose", "es", r"\besp\b")],
)


@query("""SELECT p_partkey, s AS raw, CAST(CASE p_partkey % 6 WHEN 0 THEN v * 1000 + 990 WHEN 1 THEN v * 1000 + 990.5 WHEN 2 THEN v + 0.99 WHEN 3 THEN v * 1000 + 234.56 WHEN 4 THEN v + 0.5 END AS DOUBLE) AS price FROM (
  SELECT p_partkey, p_partkey % 900 + 1 AS v, CASE p_partkey % 6 WHEN 0 THEN 'CLP $' || (p_partkey % 900 + 1) || '.990' WHEN 1 THEN (p_partkey % 900 + 1) || '.990,50' WHEN 2 THEN '$' || (p_partkey % 900 + 1) || '.99 each'
    WHEN 3 THEN (p_partkey % 900 + 1) || ',234.56' WHEN 4 THEN 'now ' || (p_partkey % 900 + 1) || ',5' ELSE 'ask' END AS s FROM part)""")
def parse_price(spark: SparkSession, sf: str) -> DataFrame:
    v = (F.col("p_partkey") % 900 + 1).cast("string")
    forms = [F.concat(F.lit("CLP $"), v, F.lit(".990")), F.concat(v, F.lit(".990,50")), F.concat(F.lit("$"), v, F.lit(".99 each")), F.concat(v, F.lit(",234.56")), F.concat(F.lit("now "), v, F.lit(",5"))]
    raw = F.lit("ask")
    for i, f in enumerate(forms):
        raw = F.when(F.col("p_partkey") % 6 == i, f).otherwise(raw)
    return table(spark, sf, "part").select("p_partkey", raw.alias("raw")).withColumn("price", parse.parse_price("raw"))


@query("""WITH t AS (SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN 'No Disponible' WHEN 1 THEN 'DISPONIBLE hoy' WHEN 2 THEN 'Disponible pronto' WHEN 3 THEN 'Preventa, disponible' WHEN 4 THEN '  ' ELSE role END AS raw FROM conversations)
SELECT *, CASE WHEN raw ILIKE '%preventa%' THEN 'preorder' WHEN raw ILIKE '%disponible pronto%' THEN 'coming_soon' WHEN raw ILIKE '%no disponible%' THEN 'out_of_stock' WHEN raw ILIKE '%disponible%' THEN 'in_stock' ELSE 'unknown' END AS status FROM t""")
def keyword_status(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("conv_id") % 6
    raw = F.when(k == 0, "No Disponible").when(k == 1, "DISPONIBLE hoy").when(k == 2, "Disponible pronto").when(k == 3, "Preventa, disponible").when(k == 4, "  ").otherwise(F.col("role"))
    return table(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw")).withColumn("status", parse.parse_stock("raw"))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/') AS url FROM pages""")
def clean_url(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", parse.clean_url("url").alias("url"))


@query(r"""SELECT page_id, sha256(coalesce(nullif(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), ''), '')) AS text_sha256 FROM pages""")
def strip_html(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.sha2(F.coalesce(parse.strip_html("html"), F.lit("")), 256).alias("text_sha256"))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN lpad(CAST(p_partkey AS VARCHAR), 12, '7') WHEN 1 THEN '0' || lpad(CAST(p_partkey AS VARCHAR), 12, '7') WHEN 2 THEN '00000000' WHEN 3 THEN p_brand ELSE ' 12-34567' || p_partkey % 10 END AS code FROM part), d AS (SELECT *, regexp_replace(code, '[^0-9]', '', 'g') AS d FROM t)
SELECT p_partkey, code, CASE WHEN length(d) IN (8, 12, 13, 14) AND d <> repeat('0', length(d)) THEN lpad(d, 14, '0') END AS gtin, upper(regexp_replace(code, '[^A-Za-z0-9]', '', 'g')) AS mpn, CASE WHEN length(d) IN (8, 12, 13, 14) THEN d ELSE trim(code) END AS clean FROM d""")
def gtin(spark: SparkSession, sf: str) -> DataFrame:
    k, id_ = F.col("p_partkey") % 5, F.lpad(F.col("p_partkey").cast("string"), 12, "7")
    code = F.when(k == 0, id_).when(k == 1, F.concat(F.lit("0"), id_)).when(k == 2, "00000000").when(k == 3, F.col("p_brand")).otherwise(F.concat(F.lit(" 12-34567"), (F.col("p_partkey") % 10).cast("string")))
    return table(spark, sf, "part").select("p_partkey", code.alias("code")).select("*", parse.gtin("code").alias("gtin"), parse.mpn("code").alias("mpn"), parse.clean_code("code").alias("clean"))


@query("SELECT p_partkey, p_brand || '::' || coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN ' ' WHEN p_size % 3 = 1 THEN CAST(p_partkey AS VARCHAR) END), ''), p_name) AS stable_key FROM part")
def stable_key(spark: SparkSession, sf: str) -> DataFrame:
    id_ = F.when(F.col("p_size") % 3 == 0, " ").when(F.col("p_size") % 3 == 1, F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select("p_partkey", parse.stable_key("p_brand", id_, "p_name").alias("stable_key"))


@query(BASE + """ SELECT offer_id, '$' || translate(format('{:,.2f}', CAST(price AS DECIMAL(18, 2))), ',.', '.,') AS shown, CASE WHEN units > 0 AND confidence >= 0.7 THEN round(price / units, 6) END AS unit_price FROM offer""")
def price_display(spark: SparkSession, sf: str) -> DataFrame:
    from pricegrain.operators.market import unit_price

    return bare_offers(spark, sf).select("offer_id", money.format_currency("price", 2).alias("shown"), F.round(unit_price(), 6).alias("unit_price"))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, json_extract_string(props, '$.missing.0') AS none, (915148800 - CAST(floor(epoch(ts)) AS BIGINT)) / 3600 AS hours, date_part('hour', ts) BETWEEN 9 AND 22 AS in_band FROM events""")
def event_fields(spark: SparkSession, sf: str) -> DataFrame:
    ts, now = F.col("ts").cast("timestamp"), F.lit("1999-01-01").cast("timestamp")
    return table(spark, sf, "events").select("event_id", parse.number(parse.dig("props", "k")).alias("k"), parse.dig("props", "missing.0").alias("none"), money.hours_since(ts, now).alias("hours"), money.in_hours(ts, 9, 22, "UTC").alias("in_band"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(strip_accents(replace(p_name, 'e', 'É'))), '\s+', ' ', 'g')) AS folded FROM part""")
def fold_accents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", text.prepare(F.replace("p_name", F.lit("e"), F.lit("É")), text.NameRules()).alias("folded"))


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9.]+', ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, replace(replace(regexp_replace(regexp_replace(t, '([0-9])\.([0-9])', '\1@\2', 'g'), '([0-9])\.([0-9])', '\1@\2', 'g'), '.', ' '), '@', '.') AS t FROM a),
w AS (SELECT doc_id, string_split(trim(regexp_replace(t, '\s+', ' ', 'g')), ' ') AS w FROM b)
SELECT doc_id, array_to_string(list_filter(w, lambda x: x <> '' AND x NOT IN ('the', 'of', 'and')), ' ') AS core, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: x <> '' AND x NOT IN ('the', 'of', 'and')))), ' ') AS name_key FROM w""")
def name_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as names; dots stay between digits alone."""
    rules = text.NameRules(stopwords=["the", "of", "and"])
    named = table(spark, sf, "documents").select("doc_id", F.col("text").alias("name"))
    found = text.normalize_names(named, "name", rules).select("doc_id", text.drop_stopwords("n.tokens", rules).alias("core"))
    return found.select("doc_id", F.array_join("core", " ").alias("core"), text.sorted_key("core").alias("name_key"))


# a phrase's words keep blanks of their own, so that phrases that follow one another don't share one; no two phrases begin with the same word
_NAMES = r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, CAST(generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS INT) AS line_no FROM documents),
p AS (SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(lower(strip_accents(replace(line, '&', ' and '))), '\(pre-?order[^)]*\)', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS punctuated FROM l),
d AS (SELECT *, regexp_replace(punctuated, '[^a-z0-9.]+', ' ', 'g') AS t FROM p),
b AS (SELECT doc_id, line_no, punctuated, trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(t, '([0-9])\.([0-9])', '\1@\2', 'g'), '([0-9])\.([0-9])', '\1@\2', 'g'), '.', ' '), '@', '.'), ' +', ' ', 'g')) AS basic FROM d),
m AS (SELECT *, regexp_replace(' ' || replace(basic, ' ', '  ') || ' ', '( of  the  and | the  of | and  the )', '#\1#', 'g') AS marked FROM b),
w AS (SELECT *, list_filter(string_split(replace(replace(replace(marked, '# of  the  and #', ' det_triple '), '# the  of #', ' det_pair '), '# and  the #', ' '), ' '), lambda x: x <> '') AS tokens FROM m),
k AS (SELECT *, list_filter(tokens, lambda x: contains(x, '_') OR regexp_full_match(x, '[0-9]+(\.[0-9]+)?') OR x = 'in' OR x NOT IN ('the', 'of', 'and')) AS kept FROM w),
c AS (SELECT *, CASE WHEN len(kept) > 0 THEN kept ELSE tokens END AS core_tokens FROM k),
h AS (SELECT *, regexp_matches(basic, '\b(english|ingles)\b') AS e1, regexp_matches(basic, '\b(spanish|espanol)\b') AS s1, regexp_matches(punctuated, '[\[(]en[\])]') AS e2, regexp_matches(punctuated, '[\[(]es[\])]') AS s2, regexp_matches(basic, '\beng\b') AS e3, regexp_matches(basic, '\besp\b') AS s3 FROM c)
SELECT doc_id, line_no, punctuated, basic, tokens, array_to_string(tokens, ' ') AS canonical, core_tokens, array_to_string(list_sort(list_distinct(core_tokens)), ' ') AS name_key,
  CASE WHEN e1 OR s1 THEN CASE WHEN NOT s1 THEN 'en' WHEN NOT e1 THEN 'es' END WHEN e2 OR s2 THEN CASE WHEN NOT s2 THEN 'en' WHEN NOT e2 THEN 'es' END WHEN e3 OR s3 THEN CASE WHEN NOT s3 THEN 'en' WHEN NOT e3 THEN 'es' END END AS language FROM h"""


@query(_NAMES)
def normalize_name(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every text as a name."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    named = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(lines).alias("line_no", "name"))
    return text.normalize_names(named, "name", RULES).select("doc_id", "line_no", "n.*", text.detect_language(F.col("n.punctuated"), F.col("n.basic"), RULES).alias("language"))


_PAIRS = """WITH p AS (SELECT DISTINCT p_name AS name FROM part), pair AS (SELECT a.name AS a, b.name AS b FROM p a JOIN p b ON split_part(a.name, ' ', 1) = split_part(b.name, ' ', 1) AND a.name <= b.name), t AS (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM pair)"""


def name_pairs(spark: SparkSession, sf: str) -> DataFrame:
    names = products(spark, sf).select("name").distinct().withColumn("head", F.substring_index("name", " ", 1))
    return names.select(F.col("name").alias("a"), "head").join(names.select(F.col("name").alias("b"), "head"), "head").filter("a <= b").select("a", "b", F.split("a", " ").alias("x"), F.split("b", " ").alias("y"))


@query(_PAIRS + " SELECT a, b, levenshtein(a, b) AS distance, least(levenshtein(a, b), 4) AS within, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 9) AS ratio FROM t")
def levenshtein_pairs(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return name_pairs(spark, sf).select("a", "b", F.levenshtein(a, b).alias("distance"), similarity.levenshtein_within(a, b, 3).alias("within"), F.round(similarity.levenshtein_ratio(a, b), 9).alias("ratio"))


@query(_PAIRS + " SELECT a, b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 9) AS jaccard, round(len(list_intersect(x, y)) / least(len(list_distinct(x)), len(list_distinct(y))), 9) AS containment FROM t")
def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return name_pairs(spark, sf).select("a", "b", F.round(similarity.jaccard(x, y), 9).alias("jaccard"), F.round(similarity.containment(x, y), 9).alias("containment"))


@query(_PAIRS + """, s AS (SELECT a, b, array_to_string(list_sort(x), ' ') AS sx, array_to_string(list_sort(y), ' ') AS sy, list_sort(list_intersect(x, y)) AS c, list_sort(list_filter(list_distinct(x), lambda i: NOT list_contains(y, i))) AS rx, list_sort(list_filter(list_distinct(y), lambda i: NOT list_contains(x, i))) AS ry FROM t),
j AS (SELECT a, b, sx, sy, array_to_string(c, ' ') AS c, array_to_string(list_concat(c, rx), ' ') AS l, array_to_string(list_concat(c, ry), ' ') AS r FROM s)
SELECT a, b, round(1 - levenshtein(sx, sy) / greatest(length(sx), length(sy)), 9) AS token_sort, round(greatest(1 - levenshtein(c, l) / greatest(length(c), length(l)), 1 - levenshtein(c, r) / greatest(length(c), length(r)), 1 - levenshtein(l, r) / greatest(length(l), length(r))), 9) AS token_set,
  round(jaro_winkler_similarity(a, b), 6) AS jaro_winkler FROM j""")
def token_ratios(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return name_pairs(spark, sf).select("a", "b", F.round(similarity.token_sort_ratio(x, y), 9).alias("token_sort"), F.round(similarity.token_set_ratio(x, y), 9).alias("token_set"), F.round(similarity.jaro_winkler("a", "b"), 6).alias("jaro_winkler"))
