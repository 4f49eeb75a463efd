"""Language ID (8): log likelihoods of the text are fused with the declared language, the address suffix and the host's prior."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricegrain.llm.common import id_type, materialize

#: The text model is fitted on at most so many documents of each language, those of the smallest hashed ids.
MAX_TRAINING_DOCS = 400
#: Languages of a model at most: they bound what the driver and a broadcast hold.
MAX_LANGUAGES = 100
BITS = 15
#: Bytes of evidence after which more text adds no certainty, as n-grams of one text are not independent: the log
#: likelihoods of a longer text, all of which is read, are scaled to those of so many bytes. A parameter of the model.
ENOUGH = 400.0
# Three-letter codes (ISO 639-2, both forms) of languages that have a two-letter code.
THREE_LETTERS = {
    "ara": "ar", "ces": "cs", "cze": "cs", "chi": "zh", "zho": "zh", "dan": "da", "deu": "de", "ger": "de", "ell": "el", "gre": "el", "eng": "en", "fin": "fi", "fra": "fr", "fre": "fr",
    "heb": "he", "hin": "hi", "hun": "hu", "ind": "id", "ita": "it", "jpn": "ja", "kor": "ko", "nld": "nl", "dut": "nl", "nor": "no", "pol": "pl", "por": "pt", "ron": "ro", "rum": "ro",
    "rus": "ru", "spa": "es", "swe": "sv", "tha": "th", "tur": "tr", "ukr": "uk", "vie": "vi",
}
#: Rows that a parent's shares count for in a host's prior.
PRIOR_ROWS = 20.0
#: A language is accepted from this posterior on, if the text holds a letter at all.
ACCEPT = 0.5


def _codes(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    return ((b[:-2] * 65536 + b[1:-1] * 256 + b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _pieces(text: str, size: int = 1 << 20) -> Iterator[bytes]:
    """A text as what _bytes makes of it; a long one in pieces, so that no more than one is worked on at a time."""
    for at in range(0, max(1, len(text)), size):
        yield _bytes(text[at : at + size])


def _bytes(text: str) -> bytes:
    """Lower case, anything but letters a space; one space at each end."""
    low = text.lower()
    if not low.isalpha():
        low = low.translate({ord(c): " " for c in set(low) if not c.isalpha()})
    return f" {' '.join(low.split())} ".encode()


@dataclass
class NgramModel:
    """log P(trigram | language), hashed to 2**BITS cells."""

    languages: list[str]
    table: np.ndarray  # [cells, languages]
    enough: float = ENOUGH

    def log_likelihood(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sums over each whole text [n, languages], scaled down beyond `enough` bytes; numbers of letters."""
        out, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            n = 0
            for data in _pieces(t):
                own = len(data) - data.count(b" ") - int(((np.frombuffer(data, dtype=np.uint8) & 0xC0) == 0x80).sum())
                if own > 0:
                    counts = np.bincount(_codes(data), minlength=1) if len(data) > 4 << BITS else None
                    out[i] += self.table[: len(counts)].T @ counts if counts is not None else self.table[_codes(data)].sum(0)
                    letters[i] += own
                    n += len(data)
            if letters[i] > 0:
                out[i] *= min(1.0, self.enough / n)
        return out, letters


def _model(languages: list[str], counts: np.ndarray) -> NgramModel:
    counts = counts + 0.05
    return NgramModel(languages, np.log(counts / counts.sum(0)))


def fit_ngrams(texts: list[str], languages: list[str]) -> NgramModel:
    known = sorted(set(languages))
    counts = np.zeros((1 << BITS, max(1, len(known))))
    for text, lang in zip(texts, languages, strict=True):
        for data in (x for x in _pieces(text) if len(x) > 2):
            counts[:, known.index(lang)] += np.bincount(_codes(data), minlength=1 << BITS)
    return _model(known, counts)


def train_ngrams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_TRAINING_DOCS, max_languages: int = MAX_LANGUAGES) -> NgramModel:
    """Fit on at most max_docs documents of each language of the column. Languages are the max_languages values that most rows
    have (of as many rows, the first by name); other values, such as misspelt ones, are of no language of the model. Documents are dealt by their hashed id; rows without
    id, language or text are left out. Trigrams are counted on Spark; the driver gets each language's counts by cell. A
    table without any such row gives a model of no language."""
    rows = docs.select(F.xxhash64(id_col).alias("_h"), F.col(id_col).cast("string").alias("_id"), F.lower(F.trim(lang_col)).alias("_lang"), F.col(text_col).alias("_text")).filter("_id IS NOT NULL AND _text <> '' AND _lang <> ''")
    common = rows.groupBy("_lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_lang").limit(max_languages).select("_lang")
    rows = rows.join(F.broadcast(common), "_lang", "left_semi")
    chosen = _candidates(rows, max_docs).groupBy("_lang").agg(F.slice(F.sort_array(F.collect_set(F.struct("_h", "_id"))), 1, max_docs).alias("_c"))
    chosen = chosen.select("_lang", F.explode("_c").alias("_c")).select("_lang", "_c._h", "_c._id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, own in pdf.groupby("_lang")["_text"]:
                total = np.zeros(1 << BITS, dtype=np.int64)
                for text in own:
                    for data in (x for x in _pieces(text) if len(x) > 2):
                        total += np.bincount(_codes(data), minlength=1 << BITS)
                cells = np.flatnonzero(total)
                cells = cells if len(cells) else np.zeros(1, dtype=np.int64)  # a language without letters is one, too
                yield pd.DataFrame({"_lang": lang, "cell": cells.astype(np.int32), "n": total[cells]})

    found = rows.join(F.broadcast(chosen), ["_lang", "_h", "_id"]).select("_lang", "_text").mapInPandas(count, "_lang string, cell int, n long")
    table = found.groupBy("_lang", "cell").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    known = sorted(set(table["_lang"]))
    counts = np.zeros((1 << BITS, max(1, len(known))))
    counts[table["cell"].to_numpy(dtype=np.int64), np.searchsorted(known, table["_lang"].tolist()) if known else []] = table["n"].to_numpy()
    return _model(known, counts)


def _candidates(rows: DataFrame, max_docs: int) -> DataFrame:
    """(_lang, _h, _id) of about twice max_docs documents of each language, by a limit to the hash of its own."""
    shares = rows.groupBy("_lang").agg((2.0 * max_docs / F.count("*")).alias("_share"))
    place = F.col("_h").cast("double") / F.lit(2.0**64) + 0.5
    return rows.select("_lang", "_h", "_id").join(F.broadcast(shares), "_lang").filter((F.col("_share") >= 1) | (place < F.col("_share"))).select("_lang", "_h", "_id")


def _normal(logs: Column) -> Column:
    """Log probabilities from logs up to a constant."""
    top = F.array_max(logs)
    total = F.aggregate(logs, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(logs, lambda x: x - top - F.log(total))


def _shares(rows: DataFrame, level: str, parent: Column, k: int) -> DataFrame:
    """Posterior mass of the level's rows by language, smoothed by the parent's shares as if it had PRIOR_ROWS rows."""
    total = F.aggregate("_mass", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn(level, F.transform(F.zip_with("_mass", parent, lambda m, p: m + PRIOR_ROWS * p), lambda x: x / (total + PRIOR_ROWS)))


def identify(docs: DataFrame, model: NgramModel, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, hint: Column | None = None) -> DataFrame:
    """(id, lang_id, posterior, accepted, letters, text_lang, posteriors) of every row.

    Evidence: the whole text's trigrams; the declared language (of the markup); a hint in the address, such as a path
    segment; the suffix of the host; and the host's prior, its rows' posteriors smoothed by those of its suffix and
    these by all rows', summed before they are shuffled. How far declarations and hints can be trusted is counted over
    all rows: P(declared | language). Each is optional and may be null or an unknown language, which is one value more.

    A declaration or hint is a language of the model as it stands, or by its first subtag (de-AT, de_AT), or as a
    three-letter code of it. A row whose text holds no letter has no evidence of its own; it gets the prior's language and
    is not accepted. Null text counts as empty. Repeated rows and ids give repeated rows, each of which counts in the
    priors. Other columns are ignored, whatever their names. An empty table gives no rows; a model of no language gives
    every row a null language and accepts none.
    """
    langs, k = model.languages, len(model.languages)
    null = F.lit(None).cast("string")
    if not langs:
        return docs.select(
            id_col, null.alias("lang_id"), F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("accepted"), F.lit(None).cast("long").alias("letters"),
            null.alias("text_lang"), F.create_map().cast("map<string,double>").alias("posteriors"),
        )

    def code(c: Column) -> Column:
        whole = F.lower(F.trim(c))
        part = F.regexp_extract(whole, "^[^-_]*", 0)
        known = {three: two for three, two in THREE_LETTERS.items() if two in langs and three not in langs}
        said = F.when(whole.isin(langs), whole).when(part.isin(langs), part)
        for three, two in known.items():
            said = said.when(part == three, F.lit(two))
        return said.when(c.isNotNull(), F.lit("?"))

    own_id, sent, kind = id_type(docs, id_col)
    given = docs.select(
        own_id.alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), code(declared if declared is not None else null).alias("_declared"),
        code(hint if hint is not None else null).alias("_hint"), F.coalesce(host if host is not None else null, F.lit("")).alias("_host"),
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            logs, letters = model.log_likelihood(pdf["_text"].tolist())
            yield pdf.drop(columns="_text").assign(_letters=letters, _logs=list(logs))

    rows = materialize(given.mapInPandas(read, f"_id {sent}, _declared string, _hint string, _host string, _letters long, _logs array<double>").withColumn("_id", F.col("_id").cast(kind)), "likelihoods")
    suffix = F.regexp_extract("_host", r"\.([^.:/]+)(?::\d+)?$", 1)
    rows = rows.withColumns({"_suffix": suffix, "_own": F.transform(_normal(F.col("_logs")), lambda x: F.exp(x))})

    # grouped aggregation over all rows, hot hosts summed before the shuffle; rows without letters say nothing
    said = rows.filter("_letters > 0")
    mass = lambda i: F.sum(F.element_at("_own", i + 1)).alias(f"_m{i}")
    sums = lambda keys: said.groupBy(*keys).agg(*map(mass, range(k))).select(*keys, F.array(*(F.coalesce(f"_m{i}", F.lit(0.0)) for i in range(k))).alias("_mass"))
    overall = said.agg(*map(mass, range(k))).first()
    total = sum(x or 0.0 for x in overall)
    base = F.array(*(F.lit(((x or 0.0) + 1) / (total + k)) for x in overall))
    by_suffix = _shares(sums(["_suffix"]), "_suffix_share", base, k).select("_suffix", "_suffix_share")
    by_host = _shares(sums(["_host", "_suffix"]).join(by_suffix, "_suffix"), "_host_share", F.col("_suffix_share"), k).select("_host", "_host_share")

    def trust(col: str) -> Column:
        """log P(value | language) for each language; 0 where there is no value. At most languages + 1 values."""
        table = {r[0]: r[1:] for r in said.filter(F.col(col).isNotNull()).groupBy(col).agg(*map(mass, range(k))).collect()}
        if not table:
            return F.array(*[F.lit(0.0)] * k)
        every = [sum(v[i] or 0.0 for v in table.values()) for i in range(k)]
        logs = F.lit(None).cast("array<double>")
        for value, v in sorted(table.items()):
            own = F.array(*(F.lit(float(np.log(((v[i] or 0.0) + 0.5) / (every[i] + 0.5 * (k + 1))))) for i in range(k)))
            logs = F.when(F.col(col) == value, own).otherwise(logs)
        return F.coalesce(logs, F.array(*[F.lit(0.0)] * k))

    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    prior = F.transform(F.coalesce("_host_share", base), lambda p: F.log(p))
    fused = rows.join(by_host, "_host", "left").withColumn("_post", F.transform(_normal(add(add(add(F.col("_logs"), prior), trust("_declared")), trust("_hint"))), lambda x: F.exp(x)))
    names = F.array(*map(F.lit, langs))
    best = F.array_max("_post")
    return fused.select(
        F.col("_id").alias(id_col),
        F.element_at(names, F.array_position("_post", best).cast("int")).alias("lang_id"),
        best.alias("posterior"),
        ((F.col("_letters") > 0) & (best >= ACCEPT)).alias("accepted"),
        F.col("_letters").alias("letters"),
        F.when(F.col("_letters") > 0, F.element_at(names, F.array_position("_logs", F.array_max("_logs")).cast("int"))).alias("text_lang"),
        F.map_from_arrays(names, "_post").alias("posteriors"),
    )
