"""License scans (1): TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory that has a licence file."""

from __future__ import annotations

import collections
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricegrain.llm.common import left_join_skewed, materialize
from pricegrain.llm.license_texts import TEMPLATES

#: Base names of files that declare the licence of their directory.
LICENCE_FILES = "(?i)^(licen[cs]e|copying|notice)([._-].*)?$"
MIN_COSINE = 0.7
_SPLIT = "[^a-z0-9]+"


def template_weights(templates: list[tuple[str, str]]) -> tuple[list[tuple[int, str, str, float, int]], dict[str, float], float]:
    """(template, license, term, weight of unit length, 1 if the term is a version) of each term; the terms' idf; the idf of a
    term that no template has. A version is a number of one or two digits."""
    counts = [collections.Counter(t for t in re.split(_SPLIT, text.lower()) if t) for _, text in templates]
    n = len(templates)
    idf = {t: math.log((n + 1) / (sum(t in c for c in counts) + 1)) + 1 for c in counts for t in c}
    rows = []
    for i, ((name, _), own) in enumerate(zip(templates, counts, strict=True)):
        length = math.sqrt(sum((tf * idf[t]) ** 2 for t, tf in own.items()))
        rows += [(i, name, t, tf * idf[t] / length, int(re.fullmatch("[0-9]{1,2}", t) is not None)) for t, tf in sorted(own.items())]
    return rows, idf, math.log(n + 1) + 1


def refinements(templates: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(general, special): a family and its versions, and the two-clause licence that a third clause may follow."""
    names = sorted({name for name, _ in templates})
    return [(a, b) for a in names for b in names if re.match(re.escape(a) + "-[0-9]", b)] + [("BSD-2-Clause", "BSD-3-Clause")]


def _likely_lines(text: Column, vocabulary: list[str]) -> Column:
    """array<struct<line_no, terms>> of the lines of whose distinct terms half or more are known."""
    lines = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n", -1), lambda line, i: F.struct(i.alias("line_no"), F.array_remove(F.split(line, _SPLIT), "").alias("terms")))

    def likely(x: Column) -> Column:
        every = F.array_distinct(x["terms"])
        known = F.size(F.filter(every, lambda t: t.isin(vocabulary)))
        return (known > 0) & (2 * known >= F.size(every))

    return F.filter(lines, likely)


def declared(likely: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(_row, own_license, cosine, line_no) from (_row, lines): what in each text is most like a template, if it is so by min_cosine.

    What is compared is each likely line and each block of adjoining likely lines, as counts of terms weighted by the
    templates' IDF; a term that no template has weighs most. It must hold two known terms, and the template's versions.
    """
    weights, idf, other = template_weights(templates)
    spark = likely.sparkSession
    table = spark.createDataFrame(weights, "template int, license string, term string, weight double, version int")
    known = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    # the place of a line among the likely ones tells the block: it grows with the line number as long as they adjoin
    blocks = F.transform("lines", lambda x, i: F.struct(x["line_no"].alias("line_no"), (x["line_no"] - i).alias("block"), x["terms"].alias("terms")))
    lines = likely.filter("size(lines) > 0").select("_row", F.inline(blocks))
    terms = lines.select("_row", "block", "line_no", F.explode("terms").alias("term")).groupBy("_row", "block", "line_no", "term").agg(F.count("*").alias("tf"))
    terms = materialize(terms, "terms")
    long = lines.groupBy("_row", "block").agg(F.count("*").alias("_n"), F.min("line_no").alias("at")).filter("_n > 1")
    of_blocks = terms.groupBy("_row", "block", "term").agg(F.sum("tf").alias("tf")).join(long, ["_row", "block"]).select("_row", F.lit(1).alias("kind"), "at", "term", "tf")
    units = terms.select("_row", F.lit(0).alias("kind"), F.col("line_no").alias("at"), "term", "tf").unionByName(of_blocks)
    units = units.join(F.broadcast(known), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    unit = ["_row", "kind", "at"]
    lengths = units.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"), F.count("idf").alias("n_known")).filter("n_known > 1")
    dots = units.join(F.broadcast(table), "term").groupBy(*unit, "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.sum("version").alias("versions"))
    wanted = collections.Counter()
    for i, *_, version in weights:
        wanted[i] += version
    needed = spark.createDataFrame(sorted(wanted.items()), "template int, needed long")
    scored = dots.join(F.broadcast(needed), "template").filter("versions = needed").join(lengths, unit)
    scored = scored.withColumn("cosine", F.round(F.col("dot") / F.col("length"), 9)).filter(F.col("cosine") >= min_cosine)
    # the best of each licence, then the best of all, then the best of those that say more than that one
    order = F.struct("cosine", F.negative("at"), F.negative("kind"), F.negative("template")).alias("o")
    best = scored.select("_row", "license", order).groupBy("_row", "license").agg(F.max("o").alias("o"))
    ranked = best.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("o", "license")), asc=False).alias("found"))  # at most as many as there are licences
    general = F.create_map(*(F.lit(x) for a in sorted({a for a, _ in refinements(templates)}) for x in (a, "|".join(["", *(b for c, b in refinements(templates) if c == a), ""]))))

    def refined(best: Column) -> Column:
        special = F.filter("found", lambda x: F.contains(F.element_at(general, best["license"]), F.concat(F.lit("|"), x["license"], F.lit("|"))))
        return F.coalesce(F.get(special, F.lit(0)), best)

    once = refined(F.get("found", F.lit(0)))
    ranked = ranked.withColumn("one", once).withColumn("own", refined(F.col("one")))  # BSD, the two clauses, the third
    return ranked.select("_row", F.col("own.license").alias("own_license"), F.col("own.o.cosine").alias("cosine"), F.negative("own.o.col2").alias("line_no"))


def _parent(path: Column) -> Column:
    """Directory of a path; '' is the root, null has none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def license_scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(id, path, own_license, cosine, line_no, license, found_in, inherited_from) of every row.

    A file has the license that one of its lines or blocks of lines declares: the likest (of things alike the first line,
    of templates alike the first). A template without version names a family (GPL); the family's likest version declared
    anywhere in the file is taken in its place, and where there is none the family stands, as the file does not say. A
    template with a version needs that version in the text. A file that declares nothing has the license of the nearest
    directory above it with a licence file (by base name) that declares one. Of several licence files in a directory the
    best cosine counts, then the smallest id. found_in is 'header', 'directory' or null.

    Null text declares nothing; a file without path is in the root. Ids of any type, null and repeated ones too, are only
    passed on: each row is a file of its own. An empty table gives no rows. Other columns are ignored, whatever their names.

    Texts are read once; what goes on are the lines of which half the terms are known. Directories, not files, are joined
    with their ancestors: they are made distinct before the shuffle, and a path of depth d makes d rows. Ancestors of very
    many directories, and directories of very many files, meet their license in a broadcast of at most as many rows as
    there can be hot keys.
    """
    vocabulary = sorted(template_weights(templates)[1])
    base = files.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), _likely_lines(F.col(text_col), vocabulary).alias("lines"))
    base = materialize(base, "license_lines")
    own = declared(base.select("_row", "lines"), templates, min_cosine)
    known = materialize(base.select("_row", "_id", "path").join(own, "_row", "left").withColumn("dir", _parent(F.col("path"))), "declared")
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILES)
    first = F.min(F.struct(F.negative("cosine"), F.col("_id").isNull(), "_id", "own_license"))
    granted = known.filter(named & F.col("own_license").isNotNull()).groupBy("dir").agg(first.alias("f")).select(F.col("dir").alias("ancestor"), F.col("f.own_license").alias("dir_license"))
    granted = materialize(granted, "granted")
    parts = F.split("dir", "/")
    above = known.select("dir").distinct().withColumn(
        "ancestor", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))))
    )
    met = left_join_skewed(materialize(above, "ancestors"), granted, "ancestor").filter("dir_license IS NOT NULL")
    nearest = met.groupBy("dir").agg(F.max(F.struct(F.length("ancestor").alias("depth"), "ancestor", "dir_license")).alias("n"))
    out = left_join_skewed(known, materialize(nearest, "nearest"), "dir")
    has_own = F.col("own_license").isNotNull()
    return out.select(
        F.col("_id").alias(id_col), "path", "own_license", "cosine", "line_no",
        F.coalesce("own_license", "n.dir_license").alias("license"),
        F.when(has_own, "header").when(F.col("n").isNotNull(), "directory").alias("found_in"),
        F.when(~has_own, F.col("n.ancestor")).alias("inherited_from"),
    )
