"""The queries of the training-data operators and, where SQL can express them, the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.llm.common import documents


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a directory for each source, one in it for each 500 ids; a document of one line is the source's
    licence file if it declares one, one of two lines that of the inner directory."""
    from pricegrain.llm.licenses import license_scan

    docs = documents(spark, sf_dir)
    inner = F.floor(F.col("doc_id") / 500).cast("string")
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    path = F.when(n_lines == 1, F.concat_ws("/", "source", F.lit("LICENSE"))).when(n_lines == 2, F.concat_ws("/", "source", inner, F.lit("LICENSE")))
    return license_scan(docs.select("doc_id", "text", path.otherwise(F.concat_ws("/", "source", inner, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))).alias("path")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricegrain.llm.line_dedup import line_dedup

    return line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"), F.hex("keep_bitmap").alias("keep_bitmap_hex"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricegrain.llm.exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    from pricegrain.llm.bpe import bpe_decode, bpe_encode

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe_decode(bpe_encode(documents(spark, sf_dir), path, tokenizers.PATTERN), path)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricegrain.llm.quality import held_out, score_quality, train_quality

    docs = documents(spark, sf_dir)
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricegrain.llm.substring_dedup import substring_dedup

    cut = substring_dedup(documents(spark, sf_dir))
    return cut.select("doc_id", F.coalesce(F.size("removed_spans"), F.lit(0)).alias("n_removed_spans"), "n_removed_words", "removed_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricegrain.llm.near_dedup import near_dedup

    return near_dedup(documents(spark, sf_dir), percent=85)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the column lang is what a document declares, its source is its host."""
    from pricegrain.llm.language import identify, train_ngrams

    docs = documents(spark, sf_dir)
    found = identify(docs, train_ngrams(docs), declared=F.col("lang"), host=F.col("source"))
    return found.withColumnRenamed("accepted", "kept")


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: the declared language is that of the html element, the hint the first segment of the address."""
    from pricegrain.llm.language import identify, train_ngrams

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>|&[a-z]+;", " ")
    return identify(
        pages.select("page_id", "url", "html", body.alias("body")), train_ngrams(documents(spark, sf_dir)), "page_id", "body",
        declared=F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]{2,3}(?:[-_][A-Za-z0-9]+)*)", 1), F.lit("")),
        host=F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1), hint=F.nullif(F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1), F.lit("")),
    )


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricegrain.llm.media import media_columns, text_media

    stored = text_media(documents(spark, sf_dir)).withColumn("own", F.struct("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")))
    read = media_columns(stored.select("own", "media"), "own")
    return read.select("own.*", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "codec", "duration", F.size("keyframes").alias("n_keyframes"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    from pricegrain.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), tokenizers.path("byte_bpe_50k.json"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricegrain.llm.filter_audit import failure_masks, filter_audit

    return filter_audit(failure_masks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricegrain.llm.fingerprints import beside_next

    return beside_next(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", "edited_sha256", F.base64("sketch").alias("fingerprint"), F.base64("edited_sketch").alias("edited_fingerprint"), "near_edited", "near_next"
    )


def source_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources: how many distinct shingles each has, and how alike it is to the whole corpus, from merged fingerprints alone."""
    from pricegrain.llm.fingerprints import contained, fingerprints, likeness, merged_sketches

    parts = merged_sketches(fingerprints(documents(spark, sf_dir)).select("source", "sketch"), "source")
    whole = merged_sketches(parts.select(F.lit(1).alias("all"), "sketch"), "all").select(F.col("sketch").alias("whole"))
    return parts.join(F.broadcast(whole)).select("source", F.base64("sketch").alias("fingerprint"), "n_distinct", likeness("sketch", "whole").alias("of_corpus"), contained("whole", "sketch").alias("covers"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricegrain.llm.clustering import delta_lloyd

    return delta_lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_line_dedup, op3_byte_bpe, op4_quality, op5_media_columns, op6_substring_dedup, op7_near_dedup, op8_language_id, pages_language, op9_best_fit_packing, op10_exact_dedup, op11_filter_audit, op12_fingerprints, source_sketches, op13_centroid_clustering)}

_SPACE = r"[\x20\x09-\x0D]"


def _templates_sql() -> str:
    from pricegrain.llm.license_texts import TEMPLATES

    return ", ".join("({}, '{}', '{}')".format(i, name, phrase.lower().replace("'", "''")) for i, (name, phrase) in enumerate(TEMPLATES))


def _refinements_sql() -> str:
    from pricegrain.llm.license_texts import TEMPLATES
    from pricegrain.llm.licenses import refinements

    return ", ".join(f"('{a}', '{b}')" for a, b in refinements(TEMPLATES))


def _lloyd_sql(rounds: int = 10) -> str:
    """Plain rounds: every distance, then every mean."""
    parts = []
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS MATERIALIZED (SELECT r, c, list_sum(list_transform(list_zip(kept.v, cent.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{i} AS cent),
a{i} AS MATERIALIZED (SELECT r, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY pos) AS v FROM (
    SELECT c, pos, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i} JOIN kept USING (r)) GROUP BY c, pos
  ) GROUP BY c UNION ALL SELECT c, v FROM c{i} WHERE c NOT IN (SELECT c FROM a{i})
)""")
    return ",\n".join(parts)


ORACLE = {
    "op11_filter_audit": rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
words AS (SELECT *, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda w: w <> '') AS words FROM d),
failed AS (
  SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM words
),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM failed LEFT JOIN said USING (doc_id) GROUP BY part, mask),
letter(b, l) AS (VALUES (1, 'A'), (2, 'B'), (4, 'C'), (8, 'D'), (16, 'E')),
orders AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM letter p, letter q, letter r, letter s, letter t
  WHERE p.b | q.b | r.b | s.b | t.b = 31
),
steps AS (SELECT filter_order, step::INTEGER AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM orders, range(1, 6) AS k(step)),
counted AS (
  SELECT part, filter_order, step, own, substr(filter_order, step, 1) AS filter, sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN mask & before > 0 AND mask & own > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN g ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN x ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, own, before
)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM counted
""",
    "op13_centroid_clustering": f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept ORDER BY sha256('3:' || vec_id), v LIMIT 8),
{_lloyd_sql()}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(cent.v, ',')) AS centroid_sha256
FROM a10 JOIN kept USING (r) JOIN c10 AS cent USING (c)
""",
    "op1_license_scan": f"""
WITH templates(template, license, phrase) AS (VALUES {_templates_sql()}), finer(general, special) AS (VALUES {_refinements_sql()}),
term AS (SELECT template, license, t, count(*) AS tf FROM (SELECT template, license, unnest(regexp_split_to_array(phrase, '[^a-z0-9]+')) AS t FROM templates) WHERE t <> '' GROUP BY ALL),
n AS (SELECT count(*) AS n FROM templates),
idf AS (SELECT t, ln((SELECT n + 1.0 FROM n) / (count(*) + 1)) + 1 AS idf FROM term GROUP BY t),
weight AS (SELECT template, license, t, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS weight, regexp_full_match(t, '[0-9]{{1,2}}') AS version FROM term JOIN idf USING (t)),
needed AS (SELECT template, count(*) FILTER (version) AS needed FROM weight GROUP BY template),
files AS (
  SELECT doc_id, text, CASE len(string_split(coalesce(text, ''), chr(10))) WHEN 1 THEN source || '/LICENSE' WHEN 2 THEN source || '/' || doc_id // 500 || '/LICENSE' ELSE source || '/' || doc_id // 500 || '/' || doc_id || '.txt' END AS path FROM documents
),
line AS (SELECT doc_id, unnest(string_split(lower(coalesce(text, '')), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM files),
words AS (SELECT doc_id, line_no, t, count(*) AS tf FROM (SELECT doc_id, line_no, unnest(regexp_split_to_array(line, '[^a-z0-9]+')) AS t FROM line) WHERE t <> '' GROUP BY ALL),
likely AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM (SELECT doc_id, line_no FROM words LEFT JOIN idf USING (t) GROUP BY ALL HAVING count(idf) > 0 AND 2 * count(idf) >= count(*))),
own_words AS (SELECT * FROM words JOIN likely USING (doc_id, line_no)),
long AS (SELECT doc_id, block, min(line_no) AS pos FROM likely GROUP BY ALL HAVING count(*) > 1),
units AS (SELECT doc_id, 0 AS kind, line_no AS pos, t, tf FROM own_words UNION ALL SELECT doc_id, 1, any_value(pos), t, sum(tf) FROM own_words JOIN long USING (doc_id, block) GROUP BY doc_id, block, t),
weighed AS (SELECT units.*, idf, tf * coalesce(idf, ln((SELECT n + 1.0 FROM n)) + 1) AS w FROM units LEFT JOIN idf USING (t)),
size AS (SELECT doc_id, kind, pos, sqrt(sum(w * w)) AS length FROM weighed GROUP BY ALL HAVING count(idf) > 1),
dot AS (SELECT doc_id, kind, pos, template, license, sum(w * weight) AS dot, count(*) FILTER (version) AS versions FROM weighed JOIN weight USING (t) GROUP BY ALL),
scored AS (SELECT doc_id, kind, pos, template, license, round(dot / length, 9) AS cosine FROM dot JOIN size USING (doc_id, kind, pos) JOIN needed USING (template) WHERE versions = needed AND round(dot / length, 9) >= 0.7),
each AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, pos, kind, template) AS place FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY cosine DESC, pos, kind, template) = 1),
top AS (SELECT * FROM each QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place) = 1),
once AS (SELECT t.doc_id, coalesce(e.license, t.license) AS license, coalesce(e.cosine, t.cosine) AS cosine, coalesce(e.pos, t.pos) AS pos FROM top t LEFT JOIN (SELECT e.*, general FROM each e JOIN finer ON special = e.license) e ON e.doc_id = t.doc_id AND e.general = t.license QUALIFY row_number() OVER (PARTITION BY t.doc_id ORDER BY e.place) = 1),
own AS (SELECT t.doc_id, coalesce(e.license, t.license) AS license, coalesce(e.cosine, t.cosine) AS cosine, coalesce(e.pos, t.pos) AS line_no FROM once t LEFT JOIN (SELECT e.*, general FROM each e JOIN finer ON special = e.license) e ON e.doc_id = t.doc_id AND e.general = t.license QUALIFY row_number() OVER (PARTITION BY t.doc_id ORDER BY e.place) = 1),
known AS (SELECT doc_id, path, license AS own_license, cosine, line_no, regexp_replace(path, '/[^/]*$', '') AS dir FROM files LEFT JOIN own USING (doc_id)),
granted AS (SELECT dir AS ancestor, own_license AS dir_license FROM known WHERE path LIKE '%/LICENSE' AND own_license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, doc_id) = 1),
above AS (SELECT doc_id, ancestor, dir_license FROM known JOIN granted ON ancestor = dir OR starts_with(dir, ancestor || '/') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(ancestor) DESC) = 1)
SELECT doc_id, path, own_license, cosine, line_no, coalesce(own_license, dir_license) AS license,
  CASE WHEN own_license IS NOT NULL THEN 'header' WHEN dir_license IS NOT NULL THEN 'directory' END AS found_in,
  CASE WHEN own_license IS NULL THEN ancestor END AS inherited_from
FROM known LEFT JOIN above USING (doc_id)
""",
    "op2_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS stays FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), decided AS (
  SELECT doc_id, pos, line, stays IS NOT NULL AND stays <> doc_id AS lost FROM keyed LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256,
  CASE WHEN bool_or(lost) THEN (
    SELECT string_agg(format('{{:04X}}', list_sum(list_transform(range(16), lambda i: CASE WHEN coalesce(bits[w * 16 + i + 1], 0) = 1 THEN 32768 >> CAST(i AS INT) ELSE 0 END))::BIGINT), '' ORDER BY w)
    FROM (SELECT list(CASE WHEN lost THEN 0 ELSE 1 END ORDER BY pos) AS bits), unnest(range(CAST(ceil(len(bits) / 16.0) AS BIGINT))) AS t(w)
  ) END AS keep_bitmap_hex
FROM decided GROUP BY doc_id
""",
    "op10_exact_dedup": rf"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
""",
}
