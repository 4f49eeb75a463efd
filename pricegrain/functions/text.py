"""Names to canonical tokens: accents, noise, punctuation, phrases, stop words, language."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Text = Column | str


def _latin() -> tuple[str, str]:
    """Letters up to U+024F and U+1E00-1EFF whose decomposition is one letter and combining marks, and these letters."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_latin(text: Text) -> Column:
    """Accents off precomposed Latin letters, in the JVM. Ligatures, widths and other scripts: strip_accents. Translating looks up each
    letter, so a text of bytes below 128 alone, as long in bytes as in letters, is left as it is."""
    return F.when(F.octet_length(text) == F.length(text), text if isinstance(text, Column) else F.col(text)).otherwise(F.translate(text, *_latin()))


@F.pandas_udf(T.StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, of any script."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


@dataclass(frozen=True)
class NameRules:
    """What a catalogue knows of its names; plain data, sent with the plan."""

    replacements: dict[str, str] = field(default_factory=dict)
    noise: Sequence[str] = ()
    #: phrase of normalised words: its canonical token, '' to delete it
    phrases: dict[str, str] = field(default_factory=dict)
    stopwords: Sequence[str] = ()
    protected: Sequence[str] = ()
    #: (level, code, pattern) with the levels strict, delimited and loose
    languages: Sequence[tuple[str, str, str]] = ()


def prepare(text: Text, rules: NameRules, full: bool = False) -> Column:
    """Replacements, accents off, lower case, noise to blanks, blanks collapsed; punctuation stays. full: strip_accents instead of fold_latin."""
    out = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for a, b in rules.replacements.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.lower(strip_accents(out) if full else fold_latin(out))
    for pattern in rules.noise:
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(F.regexp_replace(out, r"\s(?:\s+|(?<! ))", " "))


def strip_punctuation(text: Text) -> Column:
    """Of a text in lower case only letters, digits, and dots between digits stay. Such dots wait as underscores, since a class of
    Java's own is found some times faster than one that is put together; a single blank is left alone, as each match costs."""
    out = F.replace(F.col(text) if isinstance(text, str) else text, F.lit("_"), F.lit(" "))
    out = F.regexp_replace(out, r"\.(?<=[0-9]\.)(?=[0-9])", "_")
    out = F.regexp_replace(out, r"\W(?:\W+|(?<! ))", " ")
    return F.trim(F.replace(out, F.lit("_"), F.lit(".")))


def words(text: Text) -> Column:
    return F.array_remove(F.split(text, " "), "")


def replace_phrases(text: Text, phrases: dict[str, str]) -> Column:
    """E5: the tokens of a text of words with single blanks. From left to right, the longest phrase that starts at a word gives way
    to its canonical token; '' deletes it.

    One pass of a pattern marks the phrases and each is replaced with its marks, so the work is that of the text's length.
    """
    out = F.col(text) if isinstance(text, str) else text
    known = {" ".join(p.split()): token for p, token in phrases.items() if p.split()}
    if known:
        longest = sorted(known, key=lambda p: -len(p.split()))
        marked = F.regexp_replace(out, "(?<![^ ])(" + "|".join(map(re.escape, longest)) + ")(?![^ ])", "\x01$1\x01")
        for phrase in longest:
            marked = F.replace(marked, F.lit(f"\x01{phrase}\x01"), F.lit(known[phrase].replace(" ", "\x02")))
        has = F.lit(False)
        for phrase in longest:
            has = has | F.contains(out, F.lit(phrase))
        out = F.when(has, marked).otherwise(out)
    if any(" " in token for token in known.values()):
        return F.transform(words(out), lambda t: F.replace(t, F.lit("\x02"), F.lit(" ")))
    return words(out)


def is_protected(token: str, protected: Sequence[str] = ()) -> bool:
    """Canonical tokens, numbers and listed words are never dropped."""
    return "_" in token or re.fullmatch(r"[0-9]+(\.[0-9]+)?", token) is not None or token in protected


def drop_stopwords(tokens: Text, rules: NameRules) -> Column:
    """A few stop words are removed one by one, in generated code; a function of each token is interpreted."""
    out = F.col(tokens) if isinstance(tokens, str) else tokens
    dropped = [w for w in dict.fromkeys(rules.stopwords) if not is_protected(w, rules.protected)]
    if len(dropped) > 16:
        return F.filter(out, lambda t: ~t.isin(*dropped))
    for word in dropped:
        out = F.array_remove(out, word)
    return out


def sorted_key(tokens: Text) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(tokens)), " ")


def normalize_names(df: DataFrame, raw: str, rules: NameRules, out: str = "n") -> DataFrame:
    """Df with a struct of punctuated, basic, tokens, canonical, core_tokens and name_key; of null as of the empty name.

    Step by step, so that no expression is evaluated again for each token. Other scripts than Latin: give it a column that
    strip_accents has made.
    """
    staged = df.withColumn("_p", prepare(raw, rules)).withColumn("_b", strip_punctuation("_p"))
    staged = staged.withColumn("_t", replace_phrases("_b", rules.phrases)).withColumn("_k", drop_stopwords("_t", rules))
    core = F.when(F.size("_k") > 0, F.col("_k")).otherwise(F.col("_t"))
    staged = staged.withColumn("_c", core)
    return staged.withColumn(out, F.struct(
        F.col("_p").alias("punctuated"), F.col("_b").alias("basic"), F.col("_t").alias("tokens"), F.array_join("_t", " ").alias("canonical"), F.col("_c").alias("core_tokens"), sorted_key("_c").alias("name_key"),
    )).drop("_p", "_b", "_t", "_k", "_c")


def _matches(text: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns is found; as one pattern, unless references to groups would change their meaning by it."""
    if any(re.search(r"\\[1-9k]", p) for p in patterns):
        return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns))
    return text.rlike("|".join(patterns))


def detect_language(punctuated: Text, basic: Text, rules: NameRules) -> Column:
    """The first level (strict, delimited, loose) with a hit decides: one language is it, several are none.

    Delimited codes are looked for where punctuation is kept.
    """
    of = lambda level: F.col(punctuated if level == "delimited" else basic) if isinstance(basic, str) else (punctuated if level == "delimited" else basic)
    out = F.lit(None).cast("string")
    for level in ("loose", "delimited", "strict"):
        patterns: dict[str, list[str]] = {}
        for lv, code, pattern in rules.languages:
            if lv == level:
                patterns.setdefault(code, []).append(f"(?:{pattern})")
        if not patterns:
            continue
        # a pattern of all languages passes by the many names without a hit
        hits = [F.when(_matches(of(level), p), F.lit(code)) for code, p in patterns.items()]
        one = F.when(reduce(lambda a, b: a + b, (h.isNotNull().cast("int") for h in hits)) == 1, F.coalesce(*hits))
        out = F.when(_matches(of(level), [x for p in patterns.values() for x in p]), one).otherwise(out)
    return out
