"""An index of names for search: from a query's letters to the vocabulary's tokens, from those to the products. Python sees tokens only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricegrain.functions.similarity import token_likeness

#: Two tokens are alike from a Jaro-Winkler of 0.88 on. The common prefix adds at most 0.4 of what Jaro leaves, so Jaro is over 0.8,
#: and with its third part at most 1, common / len(a) + common / len(b) is over 1.4.
_SHARED = 1.4


@dataclass(frozen=True)
class NameIndex:
    """vocabulary (token, letters), letters (letter, token), spread (letter, n), postings (token, key)."""

    vocabulary: DataFrame
    letters: DataFrame
    spread: DataFrame
    postings: DataFrame

    @staticmethod
    def load(spark: SparkSession, path: str) -> NameIndex:
        return NameIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("vocabulary", "letters", "spread", "postings")))


def letters_of(token: Column) -> Column:
    """A token's letters, each with how often it came before, so that the second a is another than the first."""
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i), lambda x: x == c)).cast("string")))


def build(products: DataFrame, key: str, tokens: Column, path: str) -> NameIndex:
    """Write the index of products' tokens. The vocabulary grows with the words, not with the products; each table is sorted by what
    it is looked up by, so that a look-up skips row groups."""
    spark = products.sparkSession
    words = products.select(F.col(key).alias("key"), F.explode(F.array_distinct(tokens)).alias("token")).filter("token <> ''")
    words.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    postings.select("token").distinct().withColumn("letters", letters_of(F.col("token"))).repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{path}/vocabulary")
    each = spark.read.parquet(f"{path}/vocabulary").select(F.explode("letters").alias("letter"), "token")
    each.repartitionByRange("letter", "token").sortWithinPartitions("letter", "token").write.parquet(f"{path}/letters")
    spark.read.parquet(f"{path}/letters").groupBy("letter").agg(F.count("*").alias("n")).write.parquet(f"{path}/spread")
    return NameIndex.load(spark, path)


@F.pandas_udf(T.DoubleType())
def _likeness(q: pd.Series, t: pd.Series) -> pd.Series:
    return pd.Series([token_likeness(x, y) for x, y in zip(q, t)], dtype="float64")


def matching_tokens(index: NameIndex, wanted: Sequence[str]) -> DataFrame:
    """(nth, q, token): the vocabulary's tokens that may answer each of a query's, by counting letters.

    A token that begins a query's is looked up as such. Any other that answers shares enough letters that it must have one
    of the query's rarest: with at least c of its a letters shared, one of the a - c + 1 rarest is. Of those that have one,
    the count of all shared letters decides.
    """
    spark = index.vocabulary.sparkSession
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(wanted)], "nth int, q string").withColumn("own", letters_of(F.col("q")))
    # the fewest letters that an answer shares: 2 / 5 of them, as an answer is at least so long
    fewest = F.greatest(F.lit(1), F.ceil(F.size("own") * 0.4).cast("int"))
    known = asked.select("nth", "q", "own", F.explode("own").alias("letter")).join(index.spread, "letter", "left")
    ranked = known.groupBy("nth", "q", "own").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "letter"))).alias("by_n"))
    rare = ranked.select("nth", "q", "own", F.explode(F.slice("by_n", F.lit(1), F.size("by_n") - fewest + 1)).alias("l"))
    by_letter = rare.select("nth", "q", "own", F.col("l.letter").alias("letter")).join(index.letters, "letter").select("nth", "q", "own", "token").distinct()
    n, b = F.size("own"), F.size("letters")
    common = F.size(F.array_intersect("own", "letters"))
    counted = by_letter.join(index.vocabulary, "token").filter((common == n) | (common * (n + b) > _SHARED * n * b)).select("nth", "q", "token")
    heads = asked.select("nth", "q", F.explode(F.transform(F.sequence(F.lit(1), F.length("q")), lambda i: F.substring(F.col("q"), F.lit(1), i))).alias("token"))
    begun = heads.join(index.vocabulary.select("token"), "token").select("nth", "q", "token")
    return counted.unionByName(begun).distinct()


def find(index: NameIndex, wanted: Sequence[str], least: float = 0.45, top: int | None = None, key: str = "product_id") -> DataFrame:
    """(key, score) of the products from a score on, as similarity.search_score over all products gives it: the mean over
    the query's tokens (repeated ones count again) of the best answer among a name's. Best first, ties by key. An empty
    query finds nothing; least must be above 0, since products without any answer are not looked at."""
    if least <= 0:
        raise ValueError("least must be above 0")
    answers = matching_tokens(index, wanted).withColumn("w", _likeness("q", "token")).filter("w > 0")
    best = index.postings.join(answers, "token").groupBy("key", "nth").agg(F.max("w").alias("w"))
    scored = best.groupBy("key").agg((F.sum("w") / max(1, len(wanted))).alias("score")).filter(F.col("score") >= least)
    out = scored.select(F.col("key").alias(key), "score").orderBy(F.desc("score"), key)
    return out if top is None else out.limit(top)
