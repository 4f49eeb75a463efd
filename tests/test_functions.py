from __future__ import annotations

import random
import re
from dataclasses import replace
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pricegrain.functions import money, parse, similarity, text


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_prices(spark):
    cases = {"$36.990": 36990.0, "36.990,50": 36990.5, "$39.99": 39.99, "1,234.56": 1234.56, "CLP 45.990": 45990.0, "1.234.567": 1234567.0, "12,5": 12.5, "1,234": 1234.0, "free": None, "": None, None: None, "- 5": 5.0}
    assert values(spark, [(k,) for k in cases], "s string", parse.parse_price("s")) == list(cases.values())


def test_stock(spark):
    cases = {"No disponible": "out_of_stock", "disponible": "in_stock", "Disponible pronto": "coming_soon", "PRE-VENTA": "preorder", "": "unknown", None: "unknown", "xyz": "unknown"}
    assert values(spark, [(k,) for k in cases], "s string", parse.parse_stock("s")) == list(cases.values())
    assert values(spark, [("https://schema.org/OutOfStock",), ("http://schema.org/InStock",), ("PreOrder",), (None,)], "s string", parse.availability("s")) == ["out_of_stock", "in_stock", "preorder", "unknown"]


def test_codes(spark):
    assert values(spark, [("012345678905",), ("0012345678905",), ("00000000",), ("12",), (None,)], "s string", parse.gtin("s")) == ["00012345678905", "00012345678905", None, None, None]
    assert values(spark, [("ab-12 c",), ("--",)], "s string", parse.mpn("s")) == ["AB12C", None]
    assert values(spark, [("s", " 7 ", "u"), ("s", " ", "u"), ("s", None, "u")], "a string, b string, c string", parse.stable_key("a", "b", "c")) == ["s::7", "s::u", "s::u"]


def test_urls(spark):
    cases = {"http://a.b/c/?x=1#y": "http://a.b/c", "http://a.b": "http://a.b/", "http://a.b/": "http://a.b/", "https://a.b/c//": "https://a.b/c"}
    assert values(spark, [(k,) for k in cases], "s string", parse.clean_url("s")) == list(cases.values())
    assert values(spark, [("http://a/p?x=1&variant=9#z",)], "s string", parse.variant_url("s")) == ["http://a/p?variant=9"]
    got = values(spark, [("http://a/b/", "c?d"), ("http://a/b/", "/e"), ("http://a/b/", "mailto:x"), ("http://a/b/", "#x"), ("http://a/b/", None)], "a string, b string", parse.absolute_url("a", "b"))
    assert got == ["http://a/b/c?d", "http://a/e", None, None, None]


def test_absolute_urls(spark):
    """Equal to the standard library's join on addresses of every kind."""
    rng = random.Random(21)
    bases = ["http://a.b", "https://a.b/", "https://a.b/c/d;p?q", "http://a.b/c/d/", "http://a.b//c//d", "HTTP://A.b/x/../y/z?u=/v/w#f", "shop:p/q", "c/d", "/c/d", "//a.b/c", "", "ftp://u@h:21/f/g"]
    hrefs = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "g#s", "g?y#s", "?", "..", "../", "../g", "../..", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g//h", "//g/../h?x", "https://o.e", "http://o.e?x", "HTTPS://O.e/A/../b#c", "http:g", "tel:1", "data:,x", "é/ñ?ü", "a b", " /x ", ";x", "g;x=1/y"]
    hrefs += ["".join(rng.choice(["a", "/", "..", ".", "?", "é"]) for _ in range(rng.randint(1, 7))) for _ in range(200)]
    rows = [(b, h) for b in bases for h in hrefs]
    got = values(spark, rows, "a string, b string", parse.absolute_url("a", "b"))
    assert [(r, g) for r, g in zip(rows, got, strict=True) if g != urljoin(r[0], r[1].strip())] == []
    odd = [(None, " x\n"), (None, None), ("http://a", "  "), ("http://a", "\tjavascript:x"), ("http://a/b", "c\nd")]
    assert values(spark, odd, "a string, b string", parse.absolute_url("a", "b")) == ["x", None, None, None, "http://a/cd"]


def test_markup(spark):
    assert values(spark, [("<p>a <b>b</b>\n</p>",), ("<br>",), (None,)], "s string", parse.strip_html("s")) == ["a b", None, None]
    assert values(spark, [("&eacute;&amp;&#33;",), (None,)], "s string", parse.unescape("s")) == ["é&!", None]
    assert values(spark, [('{"a":[{"b":3}]}',)], "s string", parse.dig("s", "a.0.b")) == ["3"]
    assert values(spark, [('<meta property="og:price:amount" content="12.990">',), ("none",)], "s string", parse.meta_price("s")) == [12990.0, None]


RULES = text.NameRules(
    replacements={"—": " "}, noise=[r"\(pre-?order[^)]*\)"], phrases={"a b": "ab_x", "b c d": "bcd_x", "drop me": "", "elite box": "elite_box"}, stopwords=["the", "5"], protected=["keep"],
    languages=[("strict", "en", r"\benglish\b"), ("strict", "es", r"\bespanol\b"), ("delimited", "en", r"\[en\]"), ("loose", "es", r"\besp\b")],
)


def names(spark, rows):
    df = text.normalize_names(spark.createDataFrame([(r,) for r in rows], "name string").coalesce(1), "name", RULES)
    return df.select("n.*", text.detect_language(F.col("n.punctuated"), F.col("n.basic"), RULES).alias("language")).collect()


def test_names(spark):
    a, b, c, d, e = names(spark, ["The Élite—Box  sv3.5. (Preorder 1/2)", "a b c d", "drop me the", None, "x the 5"])
    assert a.tokens == ["the", "elite_box", "sv3.5"] and a.core_tokens == ["elite_box", "sv3.5"] and a.name_key == "elite_box sv3.5"
    assert b.tokens == ["ab_x", "c", "d"]
    assert c.tokens == ["the"] and c.core_tokens == ["the"]  # nothing relevant: all stay
    assert d.tokens == [] and d.name_key == ""
    assert e.core_tokens == ["x", "5"]  # numbers are never stop words


def plain_name(raw, rules):
    """The steps of a name word by word."""
    out = (raw or "").lower()
    for a, b in rules.replacements.items():
        out = out.replace(a, b)
    for pattern in rules.noise:
        out = re.sub(pattern, " ", out)
    out = re.sub(r"[ \t\n\x0b\f\r]+", " ", out).strip(" ")
    basic = re.sub(r"[^a-z0-9.]+", " ", out)
    basic = re.sub(" +", " ", re.sub(r"(?<![0-9])\.|\.(?![0-9])", " ", basic)).strip(" ")
    every, tokens, i = basic.split(), [], 0
    while i < len(every):
        k = next((k for k in range(4, 0, -1) if i + k <= len(every) and " ".join(every[i : i + k]) in rules.phrases), None)
        token = rules.phrases[" ".join(every[i : i + k])] if k else every[i]
        tokens += [token] if token else []
        i += k or 1
    core = [t for t in tokens if "_" in t or re.fullmatch(r"[0-9]+(\.[0-9]+)?", t) or t in rules.protected or t not in rules.stopwords] or tokens
    return out, basic, tokens, core, " ".join(sorted(set(core)))


def test_names_as_word_by_word(spark):
    rng = random.Random(3)
    parts = ["a", "b", "c", "d", "drop", "me", "elite", "box", "the", "5", "keep", "x_y", ".", "1.5", ".5.", "..", "_", "(pre-order x) ", "-", "!!", "\t", "\n ", "\x0b", "é", "中文", "\u00a0", "A", "$1", "\\", "two words"]
    rows = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [None, "", " ", "a b " * 4000]
    for rules in (RULES, replace(RULES, phrases=RULES.phrases | {"a": "one", "me drop": "two words", "box a b c": ""}, stopwords=["the", "5", "keep", *(f"w{i}" for i in range(20))])):
        found = text.normalize_names(spark.createDataFrame([(r, i) for i, r in enumerate(rows)], "name string, i int"), "name", rules).orderBy("i").select("n.*").collect()
        got = [(r.punctuated, r.basic, r.tokens, r.core_tokens, r.name_key) for r in found]
        want = [plain_name((r or "").replace("é", "e"), rules) for r in rows]
        assert [(r, g, w) for r, g, w in zip(rows, got, want, strict=True) if g != w] == []


def test_work_on_a_name_is_in_generated_code_and_linear(spark):
    """A function of each word is interpreted, and a list that grows by each is copied by each."""
    named = text.normalize_names(spark.createDataFrame([("x",)], "name string"), "name", RULES)
    plan = named.select("n.*", text.detect_language("n.punctuated", "n.basic", RULES).alias("language"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_language_patterns_with_references(spark):
    rules = text.NameRules(languages=[("strict", "en", r"\b(e)n\1\b"), ("strict", "es", r"\b(s)(e)s\1\b")])
    assert values(spark, [("a ene",), ("sess",), ("ene sess",), ("x",)], "s string", text.detect_language(F.col("s"), F.col("s"), rules)) == ["en", "es", None, None]


def test_languages(spark):
    got = [r.language for r in names(spark, ["Box ESPAÑOL", "Box english espanol", "Box [EN] esp", "Box esp", "Box en", None])]
    assert got == ["es", None, "en", "es", None, None]


def test_strip_accents(spark):
    assert values(spark, [("Ñandú ﬁ ｆ",), (None,)], "s string", text.strip_accents("s")) == ["Nandu fi f", None]
    assert values(spark, [("Ñandú",)], "s string", text.fold_latin("s")) == ["Nandu"]


@pytest.mark.parametrize("a,b,jw", [("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), ("", "", 1.0), ("a", "", 0.0), ("abc", "xyz", 0.0)])
def test_jaro_winkler(a, b, jw):
    assert similarity.jaro_winkler_text(a, b) == pytest.approx(jw, abs=1e-5)


def test_search_score(spark):
    rows = [(["red"], ["red", "box"]), (["re"], ["red"]), (["ed"], ["reds"]), (["martha"], ["marhta"]), ([], ["x"]), (["q"], []), (None, None)]
    got = values(spark, rows, "q array<string>, t array<string>", similarity.search_score("q", "t"))
    assert got == pytest.approx([1.0, 0.9, 0.75, 0.7 * 0.9611111, 0.0, 0.0, 0.0])


def test_money(spark):
    assert values(spark, [(36990.0,), (1234567.8,), (None,)], "p double", money.format_currency("p")) == ["$36.990", "$1.234.568", "—"]
    assert values(spark, [("Box A (es)",), ("a<b>",)], "s string", money.title("s")) == ["Box A · es", "a&lt;b&gt;"]
    assert values(spark, [(80.0, 100.0), (100.0, 80.0), (0.0, 5.0), (None, 5.0)], "a double, b double", money.discount_percent("a", "b")) == [20.0, 0.0, 0.0, 0.0]
    now = F.lit("2024-03-10 12:00:00").cast("timestamp")
    got = values(spark, [("30",), ("5 d",), ("2024-03-15",), ("15/03/2024",), ("x",)], "s string", F.date_format(money.parse_term("s", now, "UTC"), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2024-04-09 12:00:00", "2024-03-15 12:00:00", "2024-03-15 23:59:59", "2024-03-15 23:59:59", None]
