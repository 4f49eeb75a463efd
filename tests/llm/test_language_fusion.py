"""Language evidence: the fusion against plain Python, and what it is worth on short texts with wrong declarations."""

from __future__ import annotations

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from pricegrain.llm import language, queries

SCHEMA = "page_id long, body string, declared string, host string, hint string"


def code(model, value):
    if value is None:
        return None
    whole = value.strip(" ").lower()
    part = re.match("[^-_]*", whole)[0]
    for c in (whole, part, language.THREE_LETTERS.get(part)):
        if c in model.languages:
            return c
    return "?"


def slow(model, rows):
    """Each row's posterior, one evidence after another."""
    k = len(model.languages)
    logs, letters = model.log_likelihood([r[1] or "" for r in rows])
    norm = lambda x: [v - max(x) - math.log(sum(math.exp(u - max(x)) for u in x)) for v in x]
    own = [[math.exp(v) for v in norm(list(x))] for x in logs]
    suffix = lambda h: (re.search(r"\.([^.:/]+)(?::\d+)?$", h or "") or [None, ""])[1]
    overall, by_suffix, by_host = [0.0] * k, collections.defaultdict(lambda: [0.0] * k), collections.defaultdict(lambda: [0.0] * k)
    trust = [collections.defaultdict(lambda: [0.0] * k) for _ in range(2)]
    for r, o, n in zip(rows, own, letters):
        if n:
            for i in range(k):
                overall[i] += o[i]
                by_suffix[suffix(r[3])][i] += o[i]
                by_host[r[3] or ""][i] += o[i]
                for t, v in zip(trust, (r[2], r[4])):
                    if v is not None:
                        t[code(model, v)][i] += o[i]
    base = [(x + 1) / (sum(overall) + k) for x in overall]
    smooth = lambda mass, parent: [(m + language.PRIOR_ROWS * p) / (sum(mass) + language.PRIOR_ROWS) for m, p in zip(mass, parent)]
    out = {}
    for r, x, n in zip(rows, logs, letters):
        host = r[3] or ""
        prior = smooth(by_host[host], smooth(by_suffix[suffix(host)], base)) if host in by_host else base
        total = [a + math.log(p) for a, p in zip(x, prior)]
        for t, v in zip(trust, (r[2], r[4])):
            if v is not None and code(model, v) in t:
                every = [sum(m[i] for m in t.values()) for i in range(k)]
                total = [a + math.log((t[code(model, v)][i] + 0.5) / (every[i] + 0.5 * (k + 1))) for i, a in enumerate(total)]
        post = [math.exp(v) for v in norm(total)]
        out[r[0]] = (dict(zip(model.languages, post)), bool(n) and max(post) >= language.ACCEPT)
    return out


def corpus(n, seed, wrong=0.2):
    """Two languages that share most short words; one text in two is three words long. Their hosts' suffixes tell them apart."""
    rng = random.Random(seed)
    shared = ["la", "de", "un", "no", "es", "con", "me", "se"]
    own = {"it": ["che", "della", "questo", "sono", "anche"], "es": ["que", "del", "este", "son", "muy"]}
    rows, truth = [], {}
    for i in range(n):
        lang = rng.choice(["it", "es"])
        words = [rng.choice(shared if rng.random() < 0.8 else own[lang]) for _ in range(3 if i % 2 else 60)]
        said = lang if rng.random() > wrong else rng.choice(["it", "es", "ES-mx", "ita", "xx"])
        rows.append((i, " ".join(words), rng.choice([said, None]), f"www{rng.randint(0, 9)}.{lang if rng.random() > 0.1 else 'es'}", rng.choice([None, None, said.lower()])))
        truth[i] = lang
    return rows, truth


def run(spark, model, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.page_id: r for r in language.identify(df, model, "page_id", "body", F.col("declared"), F.col("host"), F.col("hint")).collect()}


@pytest.fixture(scope="module")
def model():
    rows, truth = corpus(300, 1)
    return language.fit_ngrams([r[1] for r in rows], [truth[r[0]] for r in rows])


def test_fusion_equals_plain_python(spark, model):
    rows, _ = corpus(300, 2)
    rows += [(1000, None, None, None, None), (1001, "", "it", "a.it", "es"), (1002, "12 34", "ESP", "b.it:80", "it_IT"), (1003, "della", "zz-IT", "", ""), (1004, "è" * 3000, " It ", "new.host.xyz", None)]
    want, got = slow(model, rows), run(spark, model, rows)
    assert set(got) == set(want)
    for i, (post, accepted) in want.items():
        assert got[i].posteriors == pytest.approx(post, abs=1e-9) and got[i].accepted == accepted


def test_fusion_helps(spark, model):
    rows, truth = corpus(1500, 3)
    got = run(spark, model, rows)
    fused = sum(got[i].lang_id == t for i, t in truth.items()) / len(rows)
    alone = sum(got[i].text_lang == t for i, t in truth.items()) / len(rows)
    declared = sum(code(model, r[2]) == truth[r[0]] for r in rows if r[2]) / sum(r[2] is not None for r in rows)
    print(f"fused {fused:.3f}, text alone {alone:.3f}, declared {declared:.3f}")
    assert fused >= alone + 0.05 and fused > declared


def test_no_evidence_of_any_language(spark, sf):
    """Without labels, or rows, there is no model; every row is answered all the same."""
    rows = [(1, "some text", None, "a.de", None), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    bare = language.train_ngrams(df, "page_id", "body", "declared")
    assert bare.languages == []
    got = language.identify(df, bare, "page_id", "body").collect()
    assert len(got) == 2 and not any(r.accepted for r in got) and {r.lang_id for r in got} == {None}
    assert language.train_ngrams(df.limit(0), "page_id", "body", "declared").languages == []


def test_query_over_an_empty_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op8_language_id(spark, str(tmp_path)).count() == 0


def test_pages(spark, sf):
    """The pages say their language in markup and address; the query agrees with both where they agree."""
    pages = {r.page_id: (re.search('<html lang="(..)"', r.html), re.search("//[^/]+/(..)/", r.url)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r.lang_id for r in queries.pages_language(spark, sf).collect()}
    assert set(got) == set(pages)
    sure = {i: m[1] for i, (m, u) in pages.items() if m and u and m[1] == u[1]}
    assert sure and sum(got[i] == v for i, v in sure.items()) >= 0.97 * len(sure)
    assert got == {r.page_id: r.lang_id for r in queries.pages_language(spark, sf).collect()}


def test_long_text_in_pieces(model):
    text = "della questo sono " * 100_000
    logs, letters = model.log_likelihood([text])
    assert letters[0] == sum(map(str.isalpha, text)) and logs[0, model.languages.index("it")] == logs[0].max()


def test_rare_values_are_no_languages(spark):
    rows = [(i, f"some words of one sort {i}", "en") for i in range(6)] + [(10 + i, f"noch ein paar andere {i}", "de") for i in range(5)] + [(20 + i, "typing errors", f"e{i}n") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.train_ngrams(docs, max_languages=2).languages == ["de", "en"]
    assert language.train_ngrams(docs, max_languages=3).languages == ["de", "e0n", "en"]
    assert len(language.train_ngrams(docs).languages) == 32
