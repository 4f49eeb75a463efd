"""Filter audit, fingerprints and clustering against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from pricegrain.llm import clustering, common, filter_audit, fingerprints, queries
from tests.llm.test_llm import LOW, empty, odd, words

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def plain_mask(text, copy):
    w = WORD.findall(text)
    failed = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), any(c in "#$%&*|" for c in text), copy]
    return {name for name, f in zip("ABCDE", failed) if f}


def plain_audit(docs, labels):
    """By going through every order with every document."""
    docs = [(i, t or "", s or "") for i, t, s in docs]
    good, toxic = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))
    ids = collections.defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            ids[t].append(i)
    rows = [(s, plain_mask(t, i is not None and i > min(ids[t])), i in good, i in toxic) for i, t, s in docs]
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                lost, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in own)
                total[f] += len(lost)
                out[part, "".join(order), step] = [f, len(left), len(lost), failing - len(lost), sum(r[1] == {f} for r in own), sum(r[2] for r in lost), sum(r[3] for r in lost)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(total[out[key][0]])
    return {k: tuple(v) for k, v in out.items()}


def audit_of(spark, docs, labels):
    frame = spark.createDataFrame([(i, t, s, "x", 7) for i, t, s in docs], "doc_id long, text string, source string, digest string, mask int")
    masks = filter_audit.failure_masks(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = filter_audit.filter_audit(masks)
    assert found.columns == "part filter_order step filter kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return {tuple(r[:3]): tuple(r[3:]) for r in found.collect()}


def test_audit_equals_every_order(spark):
    rng = random.Random(11)
    texts = [None, "", "A B", "# x", words(250, rng), words(250, rng).upper(), "a b " * 150, "a b " * 150 + "$", words(300, rng) + " %", "日本 語 " * 120, "A B C\x85", words(201, rng)]
    docs = [(i, rng.choice(texts), rng.choice(["s", "t", "t", "t", None, ""])) for i in range(300)]
    docs += [(None, texts[4], "s"), (None, texts[4], "s"), (5, texts[5], "t"), (5, texts[5], "t"), (400, words(60_000, rng), "long")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (10_000, 1, 1)]
    labels = [x for x in labels if x[0] is not None] + [(None, 1, 1)]
    want = plain_audit(docs, [x for x in labels if x[0] is not None])
    assert len(want) == 600 * 4 and audit_of(spark, docs, labels) == want


def test_audit_edges(spark):
    assert audit_of(spark, [], []) == {}
    one = audit_of(spark, [(1, None, None)], [])
    assert len(one) == 600 and one["", "ABCDE", 1] == ("A", 0, 1, 0, 1, 0, 0, 120) and one["", "EDCBA", 1] == ("E", 1, 0, 0, 0, 0, 0, 0)
    hot = [(i, "same text " * 200, f"s{i % 3}") for i in range(3000)]
    assert audit_of(spark, hot, [])["s0", "EABCD", 1] == ("E", 1, 999, 0, 0, 0, 0, 999 * 60)
    # B fails too: ten words in a hundred are distinct


def test_parity_sums_invert(spark):
    rng = random.Random(5)
    masks = [(p, rng.randrange(32)) for p in "ab" for _ in range(500)]
    sums = filter_audit.parity_sums(spark.createDataFrame(masks, "part string, mask int"), ["part"], 32)
    got = {r.part: (r.parity, r.cells) for r in sums.withColumn("cells", filter_audit.mask_cells(sums["parity"], 32)).collect()}
    for p in "ab":
        own = collections.Counter(m for q, m in masks if q == p)
        assert got[p][1] == [own[m] for m in range(32)]
        assert got[p][0] == [sum(n * (-1) ** (m & s).bit_count() for m, n in own.items()) for s in range(32)]


def shingles(text):
    w = WORD.findall(text.translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def check_beside(df, exact_below=fingerprints.K, slack=0.17):
    rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.beside_next(df).collect()}
    assert len(got) == len(rows)
    off = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            off.append(abs(near - jaccard(t, other)))
            assert off[-1] < (1e-12 if len(shingles(t) | shingles(other)) <= exact_below else slack)
    return sum(off) / max(1, len(off)), got, dict(rows)


def test_fingerprints_beside_next(spark, sf):
    docs = common.documents(spark, sf)
    mean, got, text = check_beside(docs.repartition(7))
    assert mean < 0.02
    alike = collections.defaultdict(set)
    for i, r in got.items():
        alike[text[i]].add(bytes(r.sketch))
    assert all(len(v) == 1 for v in alike.values())
    check_beside(odd(spark))
    rng = random.Random(2)
    check_beside(spark.createDataFrame([(i * 37 % 1009, words(rng.randrange(60), rng)) for i in range(1009)] + [(5000, words(50_000, rng)), (-3, "😀" * 9)], "doc_id long, text string"))
    for few in ([(1, "a b c d e f g")], [(1, "a b"), (2, None)]):
        check_beside(spark.createDataFrame(few, "doc_id long, text string"))
    assert fingerprints.beside_next(empty(spark)).count() == 0


def test_fingerprints_ties(spark):
    rows = [(None, "x y"), (None, None), (3, "a b c"), (3, "a b c"), (3, "d e f"), (2**60 + 1, "g h i j")]
    got = fingerprints.beside_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 0), (0, 3), (3, 5), (3, 5), (3, 5), (2**60 + 1, 7)]
    again = fingerprints.beside_next(spark.createDataFrame(rows[::-1], "doc_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(3)
    a, b = words(4000, rng), words(4000, rng)
    sa, sb, both = fingerprints.sketches_of([a, b, a + " " + b])
    joined = fingerprints.merge(sa, sb)
    whole = shingles(a) | shingles(b)
    assert len(np.setdiff1d(joined, both)) <= 4  # the shingles across the seam
    assert abs(fingerprints.distinct_count(joined) / len(whole) - 1) < 0.2
    assert abs(fingerprints.containment(sa, joined) - 1) < 1e-9 and abs(fingerprints.containment(joined, sa) - len(shingles(a)) / len(whole)) < 0.12
    assert fingerprints.resemblance(sa, sa) == 1 and fingerprints.resemblance(sa, sa[:0]) == 0
    df = spark.createDataFrame([(i, "hot" if i % 3 else None, words(30, random.Random(i % 500))) for i in range(3000)], "doc_id long, source string, text string").repartition(9)
    got = {r.source: r for r in fingerprints.merged_sketches(fingerprints.fingerprints(df), "source").collect()}
    texts = [(r.source, r.text) for r in df.collect()]
    for s in ("hot", None):
        own = set().union(*(shingles(t) for q, t in texts if q == s))
        want = np.unique(np.concatenate(fingerprints.sketches_of([t for q, t in texts if q == s], 10**9)))[: fingerprints.K]
        assert got[s].sketch == want.tobytes() and abs(got[s].n_distinct / len(own) - 1) < 0.2
    assert fingerprints.merged_sketches(fingerprints.fingerprints(empty(spark)), "lang").count() == 0
    odd_one = fingerprints.fingerprints(odd(spark).withColumnRenamed("digest", "sketch"))
    assert odd_one.count() == odd(spark).count() and dict(odd_one.dtypes)["sketch"] == "binary"


def test_source_sketches(spark, sf):
    got = {r.source: r for r in queries.source_sketches(spark, sf).collect()}
    own = collections.defaultdict(set)
    for r in common.documents(spark, sf).collect():
        own[r.source] |= shingles(r.text or "")
    whole = set().union(*own.values())
    assert set(got) == set(own)
    for s, x in own.items():
        assert abs(got[s].n_distinct / len(x) - 1) < 0.25 and abs(got[s].of_corpus - len(x) / len(whole)) < 0.12 and abs(got[s].covers - len(x & whole) / len(whole)) < 0.12


def plain_lloyd(rows, k=8, rounds=10, dims=64):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=order)[:k]]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        owned = collections.defaultdict(list)
        for _, v in kept:
            owned[assign(v)[1]].append(v)
        centroids = [[sum(x) // len(owned[j]) for x in zip(*owned[j])] if owned[j] else c for j, c in enumerate(centroids)]
    last = [(i, *assign(v)[::-1]) for i, v in kept]
    inertia = collections.Counter()
    for _, c, d in last:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in last)


def clustered(df):
    return sorted((str(r[0]), *r[1:]) for r in clustering.delta_lloyd(df).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clustering_equals_plain_rounds(spark, seed):
    rng = random.Random(seed)
    near = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5 + seed)]
    rows = [(i, [rng.choice([0.0, 0.25]) if seed == 1 else x + rng.gauss(0, 0.3) for x in rng.choice(near)]) for i in range(250)]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [float("nan")] * 64), (905, [float("inf")] * 64), (906, [-0.0] * 64), (7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]
    df = spark.createDataFrame([(i, v, 3, 4.0) for i, v in rows], "vec_id long, embedding array<float>, owner int, vector double")
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    assert clustered(df) == plain_lloyd(exact)


def test_clustering_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert clustered(spark.createDataFrame([], kind)) == [] == clustered(spark.createDataFrame([(1, None)], kind))
    same = [(i, [0.5] * 64) for i in range(30)]
    assert clustered(spark.createDataFrame(same, kind)) == plain_lloyd(same)  # one cluster has all, seven are empty
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert clustered(spark.createDataFrame(few, kind)) == plain_lloyd(few)
    with pytest.raises(Exception, match="64 bits"):
        clustered(spark.createDataFrame([(1, [1e30] * 64)], kind))


def test_nearest_compares_only_what_moved():
    rng = np.random.default_rng(4)
    x, c = rng.integers(-5, 5, (500, 4)), rng.integers(-5, 5, (6, 4))
    owner, d = clustering.nearest(x, np.full(500, -1, dtype=np.int32), np.zeros(500, dtype=np.int64), c, list(range(6)))
    for moved in ([0], [5], [2, 3], []):
        c = c.copy()
        c[moved] = rng.integers(-5, 5, (len(moved), 4))
        owner, d = clustering.nearest(x, owner, d, c, moved)
        whole = ((x[:, None] - c) ** 2).sum(2)
        assert (owner == whole.argmin(1)).all() and (d == whole.min(1)).all()
