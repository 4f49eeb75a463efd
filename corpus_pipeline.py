"""A corpus pipeline: each stage works on the documents that the one before kept; the last one packs them into sequences."""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.llm.common import discard, documents, free, marked, materialize
from pricegrain.llm.language import identify, train_ngrams
from pricegrain.llm.line_dedup import line_dedup
from pricegrain.llm.near_dedup import near_dedup
from pricegrain.llm.packing import pack_documents
from pricegrain.llm.substring_dedup import substring_dedup


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """kept_text becomes the text; n_chars follows it."""
    own = {"text": F.col("kept_text")}
    if "n_chars" in columns:
        own["n_chars"] = F.char_length("kept_text").cast("long")
    return docs.withColumns(own).select(*columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not identified go. The column lang is what they declare, source is their host.

    Documents without doc_id go too: no decision can name them. So do texts without a letter, null and empty ones. Rows
    that share an id are judged one by one and all stay if one is accepted. Where no document declares a language there
    is no model, and all documents go.
    """
    found = identify(docs, train_ngrams(docs), declared=F.col("lang"), host=F.col("source"))
    return docs.join(found.filter("accepted").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; no document goes, even one left empty. Null texts become empty; rows that share an id
    lose the same lines; an empty table stays empty, as in every stage."""
    return _with_text(line_dedup(docs), docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard of 0.8 or more) the document with the smallest id
    stays, with all rows of that id. Texts without words, null ones too, are near nothing and stay."""
    kept = near_dedup(docs, percent=80).filter("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document too go from the texts; no document goes. Null texts become empty; repeated
    rows keep their text."""
    return _with_text(substring_dedup(docs), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens, ids included (little-endian, 32 bits each), and their places in sequences: what a
    trainer reads. A null or empty text is one piece of the end id; rows that share an id have pieces of their own."""
    return pack_documents(docs, tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the language model nor the near-duplicate and chunk stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's documents are written; then what the stage wrote on its way goes, and so do the documents before it."""
    docs, written = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        mark = marked()
        docs = materialize(stage(spark, docs, sf_dir), name)
        free(mark, keep=docs)
        discard(*written)
        written = [docs]
    packed = STAGES[-1][1](spark, docs, sf_dir)  # reads its pieces, not the documents
    discard(*written)
    return packed
