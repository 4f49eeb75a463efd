"""Substring dedup against a slow version of its own words, and the cases that must not lose text."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricegrain.llm import common, substring_dedup
from pricegrain.llm.rolling import numbers

SPACE = b" \t\n\x0b\x0c\r"
GEAR = [int(x) for x in numbers(256, 6)]


def words(n, rng):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def slow_gear(data, i):
    return sum(GEAR[data[i - 1 - k]] << k for k in range(min(16, i))) & (1 << 64) - 1


def slow_cut(data, i):
    """Whether a chunk begins at byte i: its own definition, one byte at a time."""
    h = slow_gear(data, i)
    return (data[i] in SPACE and data[i - 1] not in SPACE and (h >> 12) % 4 == 0) or ((h >> 8) % 4096 == 0 and data[i] & 0xC0 != 0x80)


def slow_passages(data, n=16):
    """[(first word, start, end)] and the words' spans."""
    spans, at = [], None
    for i, b in enumerate(data + b" "):
        if b in SPACE and at is not None:
            spans.append((at, i))
            at = None
        elif b not in SPACE and at is None:
            at = i
    edges = {0, *(i for i in range(1, len(data)) if slow_cut(data, i)), len(data)}
    split = []
    for a, b in spans:  # long stretches without white space are many words
        starts = [a]
        if b - a > 256 or sum(x > 127 for x in data[a:b]) > 48:
            starts += [i for i in range(a + 1, b) if data[i] & 0xC0 != 0x80 and (slow_gear(data, i) >> 12) % 4 == 0]
            edges |= {i for i in starts[1:] if (slow_gear(data, i) >> 12) % 16 == 0}
        split += zip(starts, [*starts[1:], b])
    spans, edges = split, sorted(edges)
    if len(spans) < n:
        return [], spans
    chunk_words = [next((k for k, (a, _) in enumerate(spans) if a >= e), len(spans)) for e in edges]
    firsts = {len(spans) - n}
    for a, b in zip(chunk_words, chunk_words[1:]):
        firsts |= {a} | (set(range(a + 4, b, 4)) if b - a > n else set())
    return [(w, spans[w][0], spans[w + n - 1][1]) for w in sorted(firsts) if w + n <= len(spans)], spans


def slow(rows, n=16):
    """{(id, text): (spans, kept)}: passages that stand earlier, in order of id, key of the text and place, are cut."""
    seen, out = set(), {}
    for i, key, t in sorted({(i, key, t) for i, key, t in rows if i is not None and t}):
        data = t.encode()
        found, spans = slow_passages(data, n)
        gone, hit = [], set()
        for w, a, b in found:
            if data[a:b] in seen:
                hit |= set(range(w, w + n))
            seen.add(data[a:b])
        for w in sorted(hit):
            if gone and gone[-1][1] == w:
                gone[-1][1] = w + 1
            else:
                gone.append([w, w + 1])
        cut = [(spans[a - 1][1] if a else 0, len(data) if b == len(spans) else spans[b - 1][1], b - a) for a, b in gone]
        keep, at = b"", 0
        for a, b, _ in cut:
            keep, at = keep + data[at:a], b
        out[i, t] = (cut, (keep + data[at:]).decode())
    return out


def check(df):
    rows = [tuple(r) for r in df.select("doc_id", F.hash("text"), "text").collect()]
    want = slow(rows)
    got = substring_dedup.substring_dedup(df).select("doc_id", "text", "removed_spans", "n_removed_words", "kept_text").collect()
    assert len(got) == len(rows)
    for r in got:
        cut, kept = want.get((r.doc_id, r.text), ([], r.text or ""))
        assert ([tuple(s) for s in r.removed_spans or []], r.kept_text) == (cut, kept)
        assert r.n_removed_words == sum(n for *_, n in cut)
    return {(r.doc_id, r.text): r for r in got}


def test_planted_passages(spark):
    rng = random.Random(11)
    rows = []
    for k in range(30):
        passage = words(rng.randint(50, 80), rng)
        rows += [(3 * k + j, words(rng.randint(0, 60), rng) + rng.choice(" \n\t") + passage + rng.choice(["  ", "\n"]) + words(rng.randint(0, 60), rng)) for j in range(3)]
    rows += [(1000 + i, words(70, rng)) for i in range(30)]
    rows += [(2000, " ".join([words(30, rng)] * 6)), (2001, "日本語 " * 50 + "é " * 40), (2002, "x" * 9000 + " " + words(40, rng)), (2003, "and " * 300), (2004, ""), (2005, None), (None, rows[0][1])]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    later = [got[r].n_removed_words for r in rows[:90] if r[0] % 3]
    assert sum(n >= 35 for n in later) >= 0.98 * len(later)
    assert all(got[r].n_removed_words == 0 for r in rows[90:120])


def letters(n, rng, first=0x4E00, last=0x9FA5):
    return "".join(chr(rng.randint(first, last)) for _ in range(n))


def test_texts_without_blanks(spark):
    """Equal ones go; of what is repeated within others most goes; new ones stay."""
    rng = random.Random(16)
    same, plain, line = letters(5000, rng), letters(3000, rng, ord("A"), ord("Z")), "\n".join(letters(120, rng) for _ in range(6))
    rows = [(1, same), (2, same), (3, same), (4, letters(700, rng)), (5, plain), (6, "see " + plain[500:]), (7, line), (8, "\n" + line)]
    for k in range(40):
        passage = letters(250, rng)
        rows += [(100 + 2 * k + j, letters(rng.randint(30, 400), rng) + passage + letters(rng.randint(30, 400), rng)) for j in (0, 1)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    left = {i: len(r.kept_text) for (i, _), r in got.items()}
    assert left[1] == 5000 and left[2] == left[3] == 0 and left[4] == 700 and left[6] < 100 and left[7] == len(line) and left[8] < 60
    gone = [len(t) - left[i] for i, t in rows[8:] if i % 2]
    assert all(n == 0 for n in (len(t) - left[i] for i, t in rows[8:] if not i % 2))
    assert sum(gone) / len(gone) > 150 and max(gone) <= 260 and sum(n > 100 for n in gone) >= 0.9 * len(gone)


def test_long_words_by_pieces(monkeypatch):
    """Where a text is gone through piece by piece, the places are those of the whole."""
    rng = random.Random(17)
    data = np.frombuffer((letters(3000, rng) + " " + words(300, rng) + letters(900, rng, 0x61, 0x7A)).encode(), dtype=np.uint8)
    whole = substring_dedup.windows(data)
    monkeypatch.setattr(substring_dedup, "PIECE", 1000)
    assert all(np.array_equal(a, b) for a, b in zip(whole, substring_dedup.windows(data), strict=True))


def test_documents(spark, sf):
    check(common.documents(spark, sf).filter(F.length("text") < 3000).select("doc_id", "text"))


def test_hot_passages(spark):
    rng = random.Random(12)
    hot = words(60, rng)
    rows = [(i, words(20, rng) + " " + hot + " " + words(20, rng) if i % 2 else hot) for i in range(600)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))


@pytest.mark.parametrize("others", [0, 400])
def test_repeated_rows_keep_their_text(spark, others):
    """A row that is there twice is not its own earlier document, however large the table is."""
    rng = random.Random(13)
    own, two = words(60, rng), words(60, rng)
    rows = [(1, own), (1, own), (2, two), (2, two + " " + own), (3, own)] + [(10 + i, words(60, rng)) for i in range(others)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[1, own].kept_text == own and got[3, own].kept_text == ""
    assert sorted(len(got[r].kept_text) > 30 for r in rows[2:4]) in ([False, True], [True, True])


def test_clashing_names(spark):
    rng = random.Random(14)
    t = words(50, rng)
    names = ["_id", "_key", "repeated", "_cut", "first", "place", "_passages", "_Passage_ID", "_passage_key", "_passage_cut", "h1"]
    df = spark.createDataFrame([(1, t), (2, t)], "doc_id long, text string").withColumns({c: F.lit(c) for c in names}).withColumn("kept_text", F.lit("old"))
    got = sorted(substring_dedup.substring_dedup(df).collect(), key=lambda r: r.doc_id)
    assert set(got[0].asDict()) == {"doc_id", "text", *names, "removed_spans", "n_removed_words", "kept_text"}
    assert [r.kept_text for r in got] == [t, ""] and all(r[c] == c for r in got for c in names)


def test_one_very_long_text(spark):
    """Thirty million characters; the copy of its middle goes."""
    rng = random.Random(15)
    block = words(5000, rng)
    long = " ".join(f"{i} {block[(i * 37) % 20000:][:1000]}" for i in range(30_000))
    middle = " ".join(long[15_000_000:].split(" ", 101)[1:101])
    df = spark.createDataFrame([(1, long), (2, middle)], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(df).select("doc_id", "n_removed_words", F.length("kept_text").alias("left")).collect()}
    assert got[2].n_removed_words >= 80 and got[1].left > 0
