"""Line dedup (2): hashes of lines are range-partitioned and sorted by document and position; the result is a bitmap per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricegrain.llm.common import WHITE, ascii_lower, fresh, hot_keys, materialize

MIN_CHARS, MIN_DOCS = 20, 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _digest(key: Column) -> Column:
    """128 bits, so that equal digests mean equal keys at any size of corpus."""
    return F.unhex(F.md5(key))


def _bits(dropped: Column, n_lines: Column) -> Column:
    """A character for each line, 0 where it is dropped: runs of 1 between the (sorted, distinct) positions, so the work is
    that of one pass over the lines."""
    before = F.concat(F.array(F.lit(-1)), F.slice(dropped, F.lit(1), F.size(dropped) - 1))
    runs = F.zip_with(dropped, before, lambda p, q: F.concat(F.repeat(F.lit("1"), p - q - 1), F.lit("0")))
    return F.rpad(F.array_join(runs, ""), n_lines, F.lit("1"))


def _bitmap(bits: Column, n_lines: Column) -> Column:
    """Binary, first line in the highest bit; 1 keeps. Sixteen lines to each two bytes, the last ones padded with 0."""
    padded = F.rpad(bits, (F.ceil(n_lines / 16) * 16).cast("int"), F.lit("0"))
    words = F.transform(F.regexp_extract_all(padded, F.lit("[01]{16}"), F.lit(0)), lambda w: F.lpad(F.conv(w, 2, 16), 4, "0"))
    return F.unhex(F.array_join(words, ""))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, dropped array<int>) for the documents that lose lines; positions count from 0.

    A row of the shuffle is (digest of the key, document, its positions of that key): a key often repeated in one
    document is one row. Keys above the hot share of all rows are settled by a broadcast of their exact counts, at most
    1 / share of them. The rest is range-partitioned by digest and sorted by digest, document downwards: the first row
    of a digest is the one that stays.
    """
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    keyed = lines.select("doc_id", "pos", _key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    rows = materialize(keyed.select("doc_id", "pos", _digest(F.col("key")).alias("digest")), "lines")
    at_once = hot_keys(rows, "digest")
    hot = (
        rows.join(F.broadcast(at_once), "digest")
        .groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
        .groupBy("digest").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("stays"))
    )
    marked = rows.join(F.broadcast(hot), "digest", "left")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = marked.filter("n_docs IS NULL").select("digest", "doc_id", "pos").repartitionByRange(n, "digest")
    first = W.partitionBy("digest").orderBy(F.desc("doc_id"), "pos")
    # the number of documents of a key: changes of document along the sorted rows
    streamed = (
        cold.withColumns({"stays": F.first("doc_id").over(first), "new": (F.lag("doc_id").over(first).isNull() | (F.lag("doc_id").over(first) != F.col("doc_id"))).cast("int")})
        .withColumn("n_docs", F.sum("new").over(W.partitionBy("digest")))
    )
    lost = f"n_docs >= {min_docs} AND doc_id <> stays"
    return (
        marked.filter("n_docs IS NOT NULL").filter(lost).select("doc_id", "pos")
        .unionByName(streamed.filter(lost).select("doc_id", "pos"))
        .groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with n_lines, n_dropped, keep_bitmap (null: all lines stay) and kept_text.

    Lines split at \\n; null or empty text is one empty line. A line's key is the line without white space at both ends,
    A-Z lower-cased. Keys of min_chars code points or more in min_docs documents or more lose all their lines but in
    the largest id that holds them. Lines are joined again by \\n; a text that loses all lines becomes empty. Other
    columns pass, except ones named like the new columns, which are replaced. Ids are taken as unique; rows that share
    an id are one document for the counts, and lose the same positions. Rows without id are one document too. An empty
    table gives no rows.
    """
    new = ("n_lines", "n_dropped", "keep_bitmap", "kept_text")
    base = docs.select(*[c for c in docs.columns if c not in new])
    own_id, drop_col = (fresh(c, [*docs.columns, *new]) for c in ("_line_dedup_id", "_line_dedup_drops"))
    drops = repeated_lines(docs, id_col, text_col, min_chars, min_docs).toDF(own_id, drop_col)
    joined = base.join(drops, base[id_col].eqNullSafe(F.col(own_id)), "left").drop(own_id)
    dropped = F.col(drop_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    own = F.filter(dropped, lambda p: p < F.col("n_lines"))  # rows that share an id may have fewer lines
    bits = _bits(dropped, F.col("n_lines"))
    # array_join leaves nulls out
    kept = F.array_join(F.zip_with(_lines(text), F.split(bits, ""), lambda line, bit: F.when(bit == "1", line)), "\n")
    counted = joined.withColumn("n_lines", n_lines).withColumn(drop_col, own)
    return counted.withColumns({
        "n_lines": F.col("n_lines").cast("long"),
        "n_dropped": F.coalesce(F.size(dropped), F.lit(0)).cast("long"),
        "keep_bitmap": F.when(dropped.isNotNull(), _bitmap(bits, F.col("n_lines"))),
        "kept_text": F.when(dropped.isNull(), text).otherwise(kept),
    }).drop(drop_col)
