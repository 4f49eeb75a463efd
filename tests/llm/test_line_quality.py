"""The chain tells lines apart: junk lines in good documents; sampling and long texts."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricegrain.llm import common, quality

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    rows = common.documents(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("text IS NOT NULL").select("doc_id", "text", "quality").orderBy("doc_id").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    return [r for r in rows if not held(r.doc_id)][:2000], [r for r in rows if held(r.doc_id)][:600]


@pytest.fixture(scope="module")
def model(labelled):
    return quality.fit_crf([r.text for r in labelled[0]], [r.quality for r in labelled[0]])


def test_documents(labelled, model):
    score = model.score([r.text for r in labelled[1]])
    assert ((score >= quality.THRESHOLD) == np.array([r.quality for r in labelled[1]])).mean() >= 0.98


def test_junk_lines_in_good_documents(labelled, model):
    """Lines of junk documents are put into good ones, none of which the model has seen; no line was labelled in training."""
    rng = random.Random(0)
    junk = [x[:300] for r in labelled[1] if not r.quality for x in r.text.split("\n") if len(x) > 40 and any(m in x for m in ("!!", "%%%", "###", " | "))]
    hit, wrong, missed = 0, 0, 0
    for r in labelled[1]:
        if not r.quality:
            continue
        lines = [(x, True) for x in r.text.split("\n")]
        for _ in range(rng.randint(0, 2)):
            lines.insert(rng.randint(0, len(lines)), (rng.choice(junk), False))
        good = model.line_marginals(["\n".join(x for x, _ in lines)])[0][0] >= 0.5
        truth = np.array([t for _, t in lines])
        hit, wrong, missed = hit + (~truth & ~good).sum(), wrong + (truth & ~good).sum(), missed + (~truth & good).sum()
    f1 = 2 * hit / (2 * hit + wrong + missed)
    print(f"line F1 {f1:.3f} ({hit} found, {wrong} wrong, {missed} missed)")
    assert f1 >= 0.8


def test_parts_equal_the_whole_chain(model, monkeypatch):
    rng = random.Random(1)
    text = "\n".join(rng.choice(["The word of the day is here.", "x%%% y### z$$$", "", "AB!! CD!!"]) for _ in range(3000))
    whole = model.line_marginals([text])[0][0]
    monkeypatch.setattr(quality, "PART", 100)
    assert np.allclose(model.line_marginals(["", text, "a\nb"])[1][0], whole, atol=1e-6)


def test_long_lines_and_texts(model):
    line = "word and the other " * 20_000
    assert np.allclose(quality.line_features(line)[3:5], quality.line_features(line[:60_000])[3:5], atol=0.01)
    assert 0 <= model.score([line * 10, "\n" * 200_000, "a\n" * 100_000]).min() <= 1


def test_sample_is_bounded_and_whole(spark, monkeypatch):
    """Whole documents by hash up to the bounds, features only; repeated rows and clashing names don't count twice."""
    docs = spark.createDataFrame([(i, f"line {i}\n" * (i % 7), "x", "y") for i in range(200)] * 2 + [(None, "a", "x", "y"), (7, None, "x", "y")], "doc_id long, text string, _text string, quality string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, None), (4, 5), (None, 1)], "doc_id long, quality int")
    seen = {}
    monkeypatch.setattr(quality, "fit_lines", lambda documents, y: seen.update(n=len(y), lines=sum(len(x) for x, _ in documents)) or quality.LineCRF)
    quality.train_quality(docs, labels, max_docs=50, max_lines=10_000)
    assert seen["n"] == 50
    quality.train_quality(docs, labels, max_docs=150, max_lines=100)
    assert 90 <= seen["lines"] <= 100
    quality.train_quality(docs.limit(0), labels)
    assert seen["n"] == 0


def test_line_quality_rows(spark, model):
    df = spark.createDataFrame([(1, "The good line is here.\nX%%% Y###"), (1, None), (None, "a")], "doc_id long, text string")
    got = quality.line_quality(df, model).collect()
    assert len(got) == 4 and all(0 <= r.good <= 1 and r.length > 0 for r in got)
    assert quality.line_quality(df.filter(F.lit(False)), model).count() == 0


def test_long_documents_leave_the_sample_as_it_is(spark):
    rows = [(i, "\n".join(["a good line of plain words, all in order."] * 3 if i % 2 else ["### $$ 00 xx"] * 3)) for i in range(300)]
    labels = [(i, i % 2, 0) for i in range(300)]
    fit = lambda extra: quality.train_quality(spark.createDataFrame(rows + extra, "doc_id long, text string"), spark.createDataFrame(labels + [(i, 1, 0) for i, _ in extra], "doc_id long, quality int, toxic int"), max_lines=2000)
    plain, beside = fit([]), fit([(10_000 + i, "\n" * n) for i, n in enumerate([2001, 250, 50_000, 201])])
    assert np.allclose(plain.weights, beside.weights) and np.abs(plain.weights).max() > 0.1
