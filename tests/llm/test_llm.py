"""Operators of the training-data pipeline against brute force, round trips and held-out rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as tokenizers
import pytest
from pyspark.sql import functions as F

from pricegrain.llm import bpe, chunks, common, components, exact_dedup, language, licenses, line_dedup, media, near_dedup, packing, quality, queries, substring_dedup
from tests.compare import same

WS = " \t\n\x0b\x0c\r"
LOW = str.maketrans(common.UPPER, common.LOWER)
#: Nulls, empty texts, ties, repeated rows, long words, other scripts; columns that clash with the operators' own.
ODD = [None, "", " ", "\n\n", "a", "A b c d e f", "a  b c d e f", "x" * 5000, "日本語 テスト\nテスト", "the of and\tthe", "\x00 z", "The the\r\nthe", None, "don't stop'll 's", "😀😀 é́"]
PATH, PATTERN = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN


def odd(spark, repeat=3):
    rows = [(i, t, "en" if i % 2 else None, "k", "d", 1, "c") for i, t in enumerate(ODD * repeat)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept_text string, digest string, n long, component string")


def empty(spark):
    return odd(spark).limit(0)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(name, spark, sf):
    same(queries.QUERIES[name], queries.ORACLE[name], spark, sf)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def check_exact(df):
    groups = collections.defaultdict(list)
    for i, t in texts_of(df):
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", t)].append(i)
    want = {i: (min(v), len(v), i == min(v), hashlib.sha256(t.encode()).hexdigest()) for t, v in groups.items() for i in v}
    assert {r[0]: tuple(r[1:]) for r in exact_dedup.exact_dedup(df).collect()} == want


def test_exact_dedup(spark):
    check_exact(odd(spark))
    check_exact(spark.createDataFrame([(i, "hot" if i % 3 else f"t{i % 50}") for i in range(2000)], "doc_id long, text string"))
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    # rows alike in id and text, rows without id, and both: one of each group stays
    rows = [(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, "b"), (None, "b"), (4, "c " * 200_000), (3, "c  " * 200_000)] + [(9, "hot")] * 500
    got = collections.defaultdict(list)
    for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.text_sha256].append((r.kept, r.keep_id, r.group_size))
    assert sorted((sum(k for k, _, _ in v), len(v), v[0][1] or 0, v[0][2]) for v in got.values()) == [(1, 2, 0, 2), (1, 2, 3, 2), (1, 4, 1, 4), (1, 500, 9, 500)]


def check_lines(df):
    key = lambda x: x.strip(WS).translate(LOW)
    held = collections.defaultdict(set)
    rows = texts_of(df)
    for i, t in rows:
        for line in t.split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(i)
    want = {}
    for i, t in rows:
        lines = t.split("\n")
        stay = [not (len(held.get(key(x), ())) >= 3 and max(held[key(x)]) != i) for x in lines]
        bits = "".join("1" if s else "0" for s in stay)
        bits += "0" * (-len(bits) % 16)
        want[i] = (len(lines), stay.count(False), "\n".join(x for x, s in zip(lines, stay) if s), None if all(stay) else int(bits, 2).to_bytes(len(bits) // 8, "big"))
    got = line_dedup.line_dedup(df).select("doc_id", "n_lines", "n_dropped", "kept_text", "keep_bitmap").collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text, None if r.keep_bitmap is None else bytes(r.keep_bitmap)) for r in got} == want


def test_line_dedup(spark):
    random.seed(2)
    pool = [" Common line number %d of them all " % i for i in range(30)] + ["short", "", "ANOTHER LONG LINE FOR THE CASES"]
    # other line and space characters belong to the key, white space before them too
    pool += ["A line with an odd end of it" + space + end for end in ("\x85", "\u2028", "\u2029", "\xa0", "\x1c") for space in ("", " ", "\t\r")]
    rows = [(i, "\n".join(random.choice(pool) for _ in range(random.randint(1, 40))) if i % 7 else "a very hot line in every text") for i in range(300)]
    check_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    check_lines(odd(spark))
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_line_dedup_of_very_many_lines(spark):
    """Half of 150,000 lines go; a cost of lines times dropped lines would not end."""
    shared = ["this line stands in all of the texts, %d" % i for i in range(75_000)]
    own = lambda d: "\n".join(x for i, line in enumerate(shared) for x in (line, "own %d %d" % (d, i)))
    rows = [(d, own(d)) for d in range(3)] + [(3, "\n".join(shared))]
    check_lines(spark.createDataFrame(rows, "doc_id long, text string"))


def test_line_dedup_of_shared_ids(spark):
    """Rows that share an id count as one document and lose the same places, as far as they have them."""
    line = "a line of more than twenty characters"
    rows = [(1, line + "\nx"), (1, line), (1, "y"), (2, line), (3, line), (None, line), (None, line)]
    got = sorted((r.doc_id or 0, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 1, 0, line), (0, 1, 0, line), (1, 1, 1, ""), (1, 1, 1, ""), (1, 2, 1, "x"), (2, 1, 1, ""), (3, 1, 0, line)]


def reference_ids(text):
    import tiktoken

    ranks = bpe.Vocabulary.of(PATH).ranks
    return np.array(tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text), dtype="<u4").tobytes()


def test_bpe_equals_the_library(spark):
    random.seed(3)
    noise = ["".join(random.choice(" \n\tab'sR1!é日  　tionhe") for _ in range(random.randint(0, 80))) for _ in range(3000)]
    special = ["<|endoftext|> a", "aaaa" * 50, "ab" * 100, "​ x", "à"]
    rows = [(i, t) for i, t in enumerate([t for t in ODD if t] + special + noise)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (bytes(r.ids), bytes(r.decoded)) for r in bpe.bpe_decode(bpe.bpe_encode(df, PATH, PATTERN), PATH).collect()}
    for i, t in rows:
        assert got[i] == (reference_ids(t), t.encode()), t
    got = bpe.bpe_decode(bpe.bpe_encode(odd(spark), PATH, PATTERN), PATH).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in got} == dict(texts_of(odd(spark)))
    assert bpe.bpe_encode(empty(spark), PATH, PATTERN).count() == 0


def test_bpe_over_documents(spark, sf):
    got = {r.doc_id: r for r in queries.op3_byte_bpe(spark, sf).collect()}
    for i, t in texts_of(common.documents(spark, sf)):
        ids = reference_ids(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_store_forgets(monkeypatch):
    monkeypatch.setattr(chunks, "KEPT_CHUNKS", 3)
    store = chunks.ChunkStore(lambda own: [c.encode() for c in own])
    for t in ("a b c", "d e f g h", "a\nb", "x" * 100):
        assert store.encode([t, t]) == [t.encode()] * 2
    assert all("".join(chunks.split(t or "")) == (t or "") for t in ODD)


def packed(spark, df):
    rows = packing.pack_documents(df, tokenizers.path("byte_bpe_50k.json")).collect()
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return rows, len(seqs)


def test_packing(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    docs = common.documents(spark, sf).select("doc_id", "text").unionByName(odd(spark, 1).select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    docs = docs.unionByName(spark.createDataFrame([(9 * 10**6, "a <|endoftext|> b"), (9 * 10**6 + 1, " hello" * 1023), (9 * 10**6 + 2, " hello" * 2048)], "doc_id long, text string"))
    rows, n = packed(spark, docs)
    want = {}
    for i, text in texts_of(docs):
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        k = -(-len(ids) // 1024)
        edges = [0, *(len(ids) - 1024 * (k - 1 - p) for p in range(k))]
        for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            want[(i, p)] = (a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert n <= math.ceil(sum(r.length for r in rows) / 1024) * 1.02 + 1
    assert packing.pack_documents(empty(spark), tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_plans_are_good():
    for seed in range(150):
        random.seed(seed)
        cap = random.choice([10, 50, 1024])
        items = [random.randint(1, random.choice([cap, cap // 2])) for _ in range(random.randint(0, 300))]
        plan = packing.pack_plan(dict(collections.Counter(items)), cap)
        seqs, got = collections.defaultdict(list), collections.Counter()
        for length, _, n, first, offset, each in plan.runs:
            for t in range(n):
                seqs[first + t // each].append((offset + t % each * length, length))
                got[length] += 1
        assert got == collections.Counter(items) and len(seqs) == plan.sequences
        for own in seqs.values():
            own.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(n for _, n in own) <= cap
        # best fit decreasing by itself is never better
        free = []
        for x in sorted(items, reverse=True):
            fit = min((f for f in free if f >= x), default=None)
            if fit is not None:
                free.remove(fit)
            free.append((cap if fit is None else fit) - x)
        assert plan.sequences <= len(free)


def test_dominance_is_optimal_on_small_cases():
    def best(items, cap):
        seen = {}

        def go(left):
            if not left:
                return 0
            if left in seen:
                return seen[left]
            big, rest = left[-1], left[:-1]
            found = 1 + go(rest)
            for mask in range(1, 1 << len(rest)):
                own = [x for i, x in enumerate(rest) if mask >> i & 1]
                if sum(own) + big <= cap:
                    found = min(found, 1 + go(tuple(x for i, x in enumerate(rest) if not mask >> i & 1)))
            seen[left] = found
            return found

        return go(tuple(sorted(items)))

    for seed in range(60):
        random.seed(seed)
        items = [random.randint(2, 9) for _ in range(random.randint(1, 7))]
        plan = packing.Plan(dict(collections.Counter(items)), 10)
        plan.reduce()
        left = [n for n, c in plan.counts.items() for _ in range(c)]
        assert plan.sequences + best(left, 10) == best(items, 10)


def test_media(spark, sf):
    for text in [t for t in ODD] + ["x" * 64, "x" * 65, "y" * 70000]:
        data = media.build(media.pad(text))
        found = media.walk(data)
        assert media.payload_of(data, found) == media.pad(text) and found["codec"] == "raw "
        assert len(found["keyframes"]) == -(-found["n_samples"] // 8) and all(n == 64 for _, n in found["keyframes"])
    for broken in (b"", b"\0" * 8, media.build(media.pad("a"))[:-70], media.build(media.pad("a"))[:300], b"\xff" * 40, media._box(b"moov", media._box(b"trak"))):
        with pytest.raises(ValueError):
            media.walk(broken)
    files = spark.createDataFrame([(1, None), (2, b"junk-junk-junk"), (3, bytes(media.build(media.pad("ok"))))], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.media_columns(files).collect()}
    assert got[1].error and got[2].error and got[1].feature == "unreadable" and got[3].error is None and got[3].payload_bytes == 64
    rows = {r.doc_id: r for r in queries.op5_media_columns(spark, sf).collect()}
    for i, t in texts_of(common.documents(spark, sf)):
        p = media.pad(t)
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256, rows[i].tail_crc32) == (len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert media.text_media(empty(spark)).count() == 0


def test_media_wide_boxes():
    data = media.build(media.pad("abc"))
    at = data.index(b"mdat") - 4
    wide = data[:at] + (1).to_bytes(4, "big") + b"mdat" + (16 + 64).to_bytes(8, "big") + data[at + 8 :]
    with pytest.raises(ValueError):
        media.walk(data[:at] + (3).to_bytes(4, "big") + data[at + 4 :])
    assert media.walk(wide)["n_samples"] == 1
    to_end = data[:at] + (0).to_bytes(4, "big") + data[at + 4 :]
    assert media.payload_of(to_end, media.walk(to_end)) == media.pad("abc")


def test_forward_backward_is_enumeration():
    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=(1, 5, 2)), rng.normal(size=(2, 2))
    z, marg, pairs = quality.forward_backward(emit, np.ones((1, 5), bool), trans)
    total, want, both = 0.0, np.zeros((5, 2)), np.zeros((2, 2))
    for k in range(32):
        y = [k >> i & 1 for i in range(5)]
        p = math.exp(sum(emit[0, i, y[i]] for i in range(5)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total += p
        for i in range(5):
            want[i, y[i]] += p
        for a, b in zip(y, y[1:]):
            both[a, b] += p
    assert np.isclose(z[0], math.log(total)) and np.allclose(marg[0], want / total) and np.allclose(pairs[0], both / total)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    own = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert sum(r.predicted == r.quality for r in own) >= 0.95 * len(own)
    model = quality.fit_crf(["good text here.\nmore of it."] * 5 + ["x$$$ y### z%%%"] * 5, [1] * 5 + [0] * 5)
    rows = quality.score_quality(odd(spark), model).collect()
    assert len(rows) == odd(spark).count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_quality(empty(spark), model).count() == 0
    assert quality.fit_crf([], []).score(["a"])[0] > 0.5 and quality.fit_crf(["a"], [0]).score(["b"])[0] < 0.5


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    docs = common.documents(spark, sf)
    got = {r.doc_id: r for r in queries.op8_language_id(spark, sf).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert all(got[i].kept and got[i].lang_id == v for i, v in lang.items())
    model = language.train_ngrams(docs, max_docs=40)
    pages = spark.createDataFrame([(1, "die und der nicht", "de", "a.de", None), (2, "", "fr", "a.de", "fr"), (3, None, None, None, None), (4, "12 34", "xx", "", "zz"), (5, "the and of", "de", "a.de", None)], "page_id long, body string, declared string, host string, hint string")
    rows = {r.page_id: r for r in language.identify(pages, model, "page_id", "body", F.col("declared"), F.col("host"), F.col("hint")).collect()}
    assert rows[1].lang_id == "de" and rows[1].accepted and not rows[2].accepted and not rows[3].accepted and not rows[4].accepted and rows[3].text_lang is None
    assert all(abs(sum(r.posteriors.values()) - 1) < 1e-9 for r in rows.values())
    assert language.identify(odd(spark), model).count() == odd(spark).count() and language.identify(empty(spark), model).count() == 0


def test_training_beside_a_rare_language(spark, monkeypatch):
    """A language of one row leaves the others' samples as small as they are; whole texts stay on Spark."""
    rows = [(i, words(20, random.Random(i)), "en") for i in range(4000)] + [(5000, "der die das", "de"), (5001, "12", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    hashed = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    chosen = sorted(rows[:4000], key=lambda r: (hashed[r[0]], str(r[0])))[:40] + rows[4000:]
    brute = language.fit_ngrams([r[1] for r in chosen], [r[2] for r in chosen])
    with monkeypatch.context() as m:
        m.setattr(type(docs), "collect", lambda self: pytest.fail("rows go to the driver"))
        got = language.train_ngrams(docs, max_docs=40)
    assert got.languages == brute.languages == ["de", "en", "xx"] and np.array_equal(got.table, brute.table)
    keyed = docs.select(F.xxhash64("doc_id").alias("_h"), F.col("doc_id").cast("string").alias("_id"), F.col("lang").alias("_lang"))
    held = {r._lang: r["count"] for r in language._candidates(keyed, 40).groupBy("_lang").count().collect()}
    assert 40 <= held["en"] <= 160 and held["de"] == held["xx"] == 1


def brute_components(rows, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", t.translate(LOW))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def check_near(df, percent):
    got = {r[0]: tuple(r[1:]) for r in near_dedup.near_dedup(df, percent=percent).collect()}
    assert got == brute_components(texts_of(df), percent)


def drift(n, words=120, rate=0.012, seed=5):
    """Copies of copies: near ones are linked, far ones only by way of others."""
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    texts = [[word() for _ in range(words)]]
    for _ in range(n - 1):
        own = list(random.choice(texts))
        for j in range(words):
            if random.random() < rate:
                own[j] = word()
        texts.append(own)
    random.shuffle(texts)
    return [" ".join(t) for t in texts]


def test_near_dedup(spark, sf):
    check_near(common.documents(spark, sf), 85)
    check_near(odd(spark), 85)
    check_near(spark.createDataFrame(list(enumerate(drift(250))), "doc_id long, text string"), 85)
    assert near_dedup.near_dedup(empty(spark)).count() == 0


def test_near_dedup_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    check_near(spark.createDataFrame(list(enumerate(drift(200, seed=6))), "doc_id long, text string"), 80)


def test_components(spark):
    random.seed(4)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5200)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b}
    assert {k: v for k, v in got.items()} == {k: find(k) for k in parent if k in got} and set(parent) - set(got) <= loops


def words(n, rng):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_substring_dedup(spark):
    rng = random.Random(3)
    rows = []
    for k in range(100):
        passage = words(55, rng)
        rows += [(3 * k + j, words(rng.randint(0, 80), rng) + rng.choice(" \n") + passage + rng.choice(" \n") + words(rng.randint(0, 80), rng)) for j in range(3)]
    clean = [(10**6 + i, words(100, rng)) for i in range(100)]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    assert all(got[i].n_removed_words == 0 and got[i].kept_text == t for i, t in clean)
    assert all(got[3 * k].n_removed_words == 0 for k in range(100))
    later = [got[3 * k + j].n_removed_words for k in range(100) for j in (1, 2)]
    assert sum(n > 0 for n in later) >= 0.98 * len(later) and sum(later) > 35 * len(later)
    for i, t in rows:
        data, at, left = t.encode(), 0, []
        for s in got[i].removed_spans or []:
            left.append(data[at : s.start])
            at = s.end
        assert b"".join([*left, data[at:]]).decode() == got[i].kept_text


def test_substring_keeps_what_no_one_text_said(spark):
    """Every short piece of the last text stands in some earlier one, in other company; only the copied sentence goes."""
    rng = random.Random(5)
    vocabulary = words(40, rng).split()
    earlier = [(i, " ".join(rng.choice(vocabulary) for _ in range(400))) for i in range(300)]
    copied = " ".join(earlier[7][1].split()[100:160])
    new = " ".join(rng.choice(vocabulary) for _ in range(2000))
    rows = [*earlier, (1000, new), (1001, words(30, rng) + " " + copied + " " + words(30, rng)), (1002, new)]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000].n_removed_words == 0 and got[1000].kept_text == new
    assert 40 <= got[1001].n_removed_words <= 60 and got[1002].kept_text == ""
    seen = {i: t for i, t in rows}
    for s in got[1001].removed_spans:
        assert seen[1001].encode()[s.start : s.end].decode().strip() in earlier[7][1]


def test_chunks_resist_insertion():
    rng = random.Random(1)
    a = words(2000, rng).encode()
    b = b"some new words " + a[:5000] + b" inserted here " + a[5000:]
    cut = lambda x: {bytes(x[i:j]) for i, j in zip(*(lambda c: (c[:-1], c[1:]))(substring_dedup.cuts(np.frombuffer(x, dtype=np.uint8)).tolist()))}
    assert len(cut(a) - cut(b)) <= 4


def test_substring_odd(spark):
    got = substring_dedup.substring_dedup(odd(spark))
    assert got.count() == odd(spark).count() and {"digest", "lang", "component"} <= set(got.columns)
    assert all(r.kept_text is not None for r in got.collect()) and substring_dedup.substring_dedup(empty(spark)).count() == 0


def test_licenses(spark):
    rows = [
        (1, "a/b/x.py", "code\n// Licensed under the Apache License, Version 2.0.\ncode"), (2, "a/b/y.py", "nothing here"), (3, "a/LICENSE", "Released under the MIT License."), (4, "a/c/d/z.py", None),
        (5, "e/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), (6, "e/f.py", ""), (7, "top.py", "x"), (8, None, "Licensed under CC BY-NC 4.0."), (9, "a/LICENSE.md", "the MIT license is released"),
    ]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[1].license == "Apache-2.0" and got[1].line_no == 1 and got[1].found_in == "header"
    assert got[2].license == "MIT" and got[2].inherited_from == "a" and got[4].license == "MIT" and got[4].found_in == "directory"
    assert got[6].license == "GPL-3.0" and got[7].license is None and got[7].found_in is None and got[8].license == "CC-BY-NC-4.0"
    assert licenses.license_scan(odd(spark).withColumn("path", F.lit("p/q"))).count() == odd(spark).count()
    assert licenses.license_scan(empty(spark).withColumn("path", F.lit("p"))).count() == 0


def test_null_ids_keep_large_ones(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(None, "a b c d e f g h"), (None, None), (1, "a b c d e f g h"), (big, "x y z w v u")], "doc_id long, text string").coalesce(1)
    model = language.fit_ngrams(["the of and", "der die das"], ["en", "de"])
    for found in (
        exact_dedup.exact_dedup(df), line_dedup.line_dedup(df), bpe.bpe_decode(bpe.bpe_encode(df, PATH, PATTERN), PATH), quality.score_quality(df, quality.fit_crf(["a"], [1])), media.media_columns(media.text_media(df)),
        substring_dedup.substring_dedup(df), near_dedup.near_dedup(df), language.identify(df, model), packing.pack_documents(df, tokenizers.path("byte_bpe_50k.json")), licenses.license_scan(df.withColumn("path", F.lit("p"))),
    ):
        assert sorted(r.doc_id or 0 for r in found.select("doc_id").collect()) == [0, 0, 1, big]


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = common.documents(spark, sf)
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, sf), name)
        if name != "packing":
            assert sorted(out.columns) == sorted(columns)
        if name == "near_dedup":
            brute = brute_components(texts_of(docs), 80)
            assert {r.doc_id for r in out.collect()} == {i for i, v in brute.items() if v[2]}
        elif name == "packing":
            assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
        else:
            assert out.count() == docs.count()
        docs = out
    assert corpus_pipeline.run(spark, sf).count() == docs.count() and before == 200


def test_pipeline_odd(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = odd(spark).select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")).unionByName(common.documents(spark, sf).withColumn("doc_id", F.col("doc_id") + 1000))
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, sf), name)
    assert docs.count() > 0
