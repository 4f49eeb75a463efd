"""Operators without SQL against plain Python, and worked cases of lookups, ledgers and states."""

from __future__ import annotations

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pricegrain.functions import money
from pricegrain.operators import changes, grouping, resolve, search
from pricegrain.plans import matching, service
from pricegrain.sources import tables
from pricegrain.streaming import twins


def plain_ids(assignment, old):
    """Groups in order of their keys take what most of their offers had and no group before took."""
    had, members, taken, out = dict(old), collections.defaultdict(list), set(), {}
    for i, key in assignment:
        members[key].append(i)
    for key in sorted(members):
        votes = collections.Counter(had[i] for i in members[key] if had.get(i) is not None)
        free = [p for p, _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])) if p not in taken]
        out[key] = free[0] if free else None
        taken |= {free[0]} if free else set()
    return out


def test_kept_ids_follow_the_groups(spark, sf):
    part = [(r.p_partkey, r.p_size) for r in spark.read.parquet(f"{sf}/part.parquet").collect()]
    want = plain_ids([(k, k - k % 4) for k, _ in part], [(k, s if s % 3 == 0 else None) for k, s in part])
    assert {r.product_key: r.product_id for r in service.kept_ids(spark, sf).collect()} == want
    a = [(i, i // 3) for i in range(30)]
    old = [(i, 100 + (i * 7) % 11 % 4) for i in range(30)]
    got = resolve.keep_ids(spark.createDataFrame(a, "id long, product_key long"), spark.createDataFrame(old, "id long, product_id long")).collect()
    assert {r.product_key: r.product_id for r in got} == plain_ids(a, old)
    # the first group's product is the second one's first choice, which then takes its next
    a, old = [(1, 1), (2, 1), (3, 2), (4, 2), (5, 2)], [(1, 7), (2, 7), (3, 7), (4, 7), (5, 8)]
    got = resolve.keep_ids(spark.createDataFrame(a, "id long, product_key long"), spark.createDataFrame(old, "id long, product_id long")).collect()
    assert {r.product_key: r.product_id for r in got} == {1: 7, 2: 8}


def plain_groups(nodes, scored, same, different, gtins, auto):
    """One greedy pass over all edges, with labels looked up in lists."""
    label = {i: i for i in nodes}
    apart = {frozenset(p) for p in different}
    edges = [(0, 0.0, a, b) for a, b in gtins] + [(1, 0.0, a, b) for a, b in same] + [(2, -s, a, b) for a, b, s in scored if s >= auto and frozenset((a, b)) not in apart]
    for _, _, a, b in sorted(edges):
        if a not in label or b not in label or label[a] == label[b]:
            continue
        one, two = ([i for i in nodes if label[i] == label[x]] for x in (a, b))
        values = zip(*(nodes[i] for i in one + two))
        if any(len({v for v in col if v is not None}) > 1 for col in values) or any(frozenset((p, q)) in apart for p in one for q in two):
            continue
        for i in one + two:
            label[i] = min(label[a], label[b])
    return {i: min(j for j in nodes if label[j] == label[i]) for i in nodes}


def test_groups_equal_a_plain_greedy(spark, sf):
    c = matching.candidates(spark, sf)
    scored = resolve.score_pairs(c, resolve.candidate_pairs(c)).filter("score >= 75")
    same, different = (matching._decisions(spark, sf, k) for k in ("same", "different"))
    cfg = resolve.Scoring()
    rows = [(r.a, r.b, r.score) for r in scored.collect()]
    nodes = {r.id: tuple(r[x] for x in cfg.identity) for r in c.collect()}
    decided = [[(r.a, r.b) for r in d.collect()] for d in (same, different)]
    gtins = [(r.a, r.b) for r in resolve.gtin_edges(c).collect()]
    want = plain_groups(nodes, rows, *decided, gtins, cfg.auto)
    got = matching.clusters(spark, sf).collect()
    assert {r.id: r.product_key for r in got} == want
    reviews = {(r.a, r.b) for r in matching.review_queue(spark, sf).collect()}
    assert reviews == {(a, b) for a, b, _ in rows if want[a] != want[b] and (a, b) not in set(decided[1])}


@pytest.mark.parametrize("block", [60, 10_000])
def test_groups_in_blocks_equal_a_plain_greedy(spark, block):
    """Random graphs, a star and a long path, gone through whole and in blocks of the order."""
    rng = random.Random(block)
    nodes = {i: (rng.choice([None, None, "x", "y"]), rng.choice([None, None, None, "p", "q"]), None) for i in range(120)}
    nodes |= {i: ("s" if i % 40 else "t", None, None) for i in range(200, 260)} | {i: (None, "m", None) for i in range(300, 340)} | {400: (None, None, None)}
    pick = lambda n, lo=0, hi=119: {tuple(sorted(rng.sample(range(lo, hi + 1), 2))) for _ in range(n)}
    scored = [(a, b, float(rng.choice([90, 92.5, 95, 95, 99, 80]))) for a, b in pick(160)] + [(300 + i, 301 + i, 99.0 - i % 3) for i in range(39)]
    same, different, gtins = sorted(pick(12)), sorted(pick(12)), [(200, i) for i in range(201, 260)] + sorted(pick(10))
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    edges = frame([(a, b, 0, 100.0, "G") for a, b in gtins] + [(a, b, 1, 100.0, "M") for a, b in same] + [(a, b, 2, s, "T") for a, b, s in scored if s >= 90 and (a, b) not in set(different)], "a long, b long, stage int, score double, method string")
    both = [(a, b) for a, b in different] + [(b, a) for a, b in different]
    groups, joined, refused = grouping.grouped(frame([(i, list(v)) for i, v in nodes.items()], "id long, values array<string>"), frame(both, "a long, b long"), edges, block)
    got = {i: i for i in nodes} | {r.id: r.group for r in groups.collect()}
    assert got == plain_groups(nodes, scored, same, different, gtins, 90)
    assert all(got[r.a] == got[r.b] for r in joined.collect()) and all(got[r.a] != got[r.b] for r in refused.collect())


def test_kept_ids_of_a_long_chain(spark):
    """Each group's first choice is the one that the group before it falls back on."""
    n = 10_000
    ranked = spark.createDataFrame([(i, 1, i // 2) for i in range(n)] + [(i, 2, i) for i in range(n)], "product_key long, nth int, product_id long")
    taken, want = set(), {}
    for i in range(n):
        for p in (i // 2, i):
            if p not in taken:
                want[i] = p
                taken.add(p)
                break
    got = {r.product_key: r.product_id for r in grouping.first_come(ranked, "product_key").collect()}
    assert got == want


def test_scores_are_cached_by_fingerprint(spark, sf, tmp_path):
    c = matching.candidates(spark, sf)
    first = resolve.cached_scores(c, f"{tmp_path}/s").count()
    stamp = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert resolve.cached_scores(c.repartition(5), f"{tmp_path}/s").count() == first and {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")} == stamp
    assert resolve.fingerprint(c.filter("id <> 5")) != resolve.fingerprint(c) != resolve.fingerprint(c, resolve.Scoring(auto=91.0))


def test_forgotten_pairs_and_breakdowns(spark):
    d = spark.createDataFrame([("a", "x", "different"), ("x", "b", "different"), ("a", "b", "different"), ("a", "x", "same"), ("c", "x", "different")], "a_key string, b_key string, decision string")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "stable_key string")
    assert {tuple(r) for r in resolve.forget_pairs(d, keys("a", "b"), keys("x", "y")).collect()} == {("a", "b", "different"), ("a", "x", "same"), ("c", "x", "different")}
    raw = spark.createDataFrame([('{"a": 1, "b": "x"}',), ("[1]",), ("nope",), (None,), ("",)], "t string")
    assert [r[0] for r in raw.select(resolve.breakdown_of("t")).collect()] == [{"a": "1", "b": "x"}, {}, {}, {}, {}]


def test_presale_is_off_without_shops(spark):
    e = spark.createDataFrame([("s", "drop"), ("s", "new"), ("t", "drop")], "store string, type string")
    run = lambda **k: sorted(tuple(r) for r in changes.presale(e, k.pop("stores", ["s"]), ["new"], ["drop"], F.lit("2024-02-01").cast("date"), **k).collect())
    assert run() == [("s", "drop"), ("s", "new")] == run(until="2024-02-01") == run(until="someday")
    assert run(stores=[]) == run(until="2024-01-31") == run(enabled=False) == [("s", "drop"), ("t", "drop")]


def test_seen_notices_and_lookups(spark):
    hits = spark.createDataFrame([(1, True), (2, False), (3, None)], "hit_id long, seen boolean")
    assert {r.hit_id: r.seen for r in changes.mark_seen(hits, hits.filter("hit_id = 2")).collect()} == {1: True, 2: True, 3: False}
    assert all(r.seen for r in changes.mark_seen(hits).collect())
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    states = spark.createDataFrame([(1, t(h), p) for h, p in [(0, ["x"]), (5, ["x"]), (13, ["x"]), (14, ["y", "x"]), (15, ["x", "y"]), (16, []), (17, ["x"])]], "store_id long, checked_at timestamp, problems array<string>")
    told = lambda s, **k: [r.checked_at for r in changes.health_notices(s, ["checked_at"], **k).orderBy("checked_at").collect()]
    assert told(states) == [t(0), t(13), t(14), t(17)] and told(states, recovered=True) == [t(0), t(13), t(14), t(16), t(17)]
    late = spark.createDataFrame([(1, t(h), ["x"]) for h in (0, 23, 25, 36)], "store_id long, checked_at timestamp, problems array<string>")
    assert told(late) == [t(0), t(23), t(36)] and told(late, hours=0) == [t(0)]
    rows = spark.createDataFrame([(1, "one"), (2, "1")], "k long, c string")
    assert {r.k for r in search.by_id_or_code(rows, "1", "k", "c").collect()} == {1, 2} and search.by_id_or_code(rows, "zz", "k", "c").count() == 0
    assert search.suggest(rows.withColumnRenamed("k", "product_id"), F.lit(1.0), " a ").count() == 0


def test_merge_candidates_of_bases_that_know_nothing(spark):
    p = spark.createDataFrame([(1, "b", "g", None), (2, "a", "g", "s"), (3, "c", None, None), (4, "d", "h", "s")], "product_id long, name string, game string, set_code string")
    got = collections.defaultdict(list)
    for r in search.merge_candidates(p, p, 2, ("game", "set_code")).orderBy("base", "nth").collect():
        got[r.base].append(r.candidate)
    assert got == {1: [2], 3: [2, 1]}


def test_decisions_by_key(spark):
    d = spark.createDataFrame([("a", "b", "same"), ("a", "zz", "same"), ("b", "c", "different")], "a_key string, b_key string, decision string")
    keys = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, stable_key string")
    assert [tuple(r) for r in resolve.keyed_pairs(d, keys, "same").collect()] == [(1, 2)]
    own = spark.createDataFrame([(9, "a"), (9, "b"), (9, "c"), (8, "d")], "product_id long, stable_key string")
    apart = resolve.separate(own.filter("stable_key = 'b'"), own)
    assert {(r.a_key, r.b_key) for r in apart.collect()} == {("a", "b"), ("b", "c")}
    assert {tuple(r)[:2] for r in resolve.rejoin(d, keys.filter("id = 3")).collect()} == {("a", "b"), ("a", "zz")}


def test_times(spark):
    now = dt.datetime(2024, 1, 10, 12)
    df = spark.createDataFrame([(now - dt.timedelta(hours=5), now), (None, now), (now - dt.timedelta(minutes=30), now)], "t timestamp, now timestamp")
    due = [r[0] for r in df.select(changes.next_due(F.col("t"), F.col("now"), 1)).collect()]
    assert due == [now + dt.timedelta(minutes=1), now + dt.timedelta(minutes=1), now + dt.timedelta(minutes=30)]
    shown = spark.createDataFrame([(1, now - dt.timedelta(days=2)), (2, now - dt.timedelta(days=9))], "product_id long, shown_at timestamp")
    left = changes.cooled_down(spark.createDataFrame([(1,), (2,), (3,)], "product_id long"), shown, F.lit(now), 7)
    assert {r.product_id for r in left.collect()} == {2, 3}
    assert money.format_currency(F.lit(1.0)) is not None


def test_rounding_of_halves(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (1234567.5,), (0.49,), (None,)], "x double")
    assert [r[0] for r in df.select(money.format_currency("x")).collect()] == ["$1", "$2", "$3", "$1.234.568", "$0", "—"]


def test_tables_and_settings(spark, sf):
    assert tables.read_table(spark, f"{sf}/region.parquet").count() == 5
    assert tables.sql(spark, "SELECT :a + 1 AS x", a=4).first().x == 5
    assert tables.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


@pytest.mark.parametrize("first", [10.0, None])
def test_streams_take_nulls(spark, tmp_path, first):
    """A null value, status or price ends no stream, and tells what the batch forms tell."""
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([(1, 1, t(0), first), (1, 2, t(1), None), (1, 3, t(2), 8.0), (1, 4, t(3), 9.0), (1, 5, t(4), 7.0)], "user_id long, event_id long, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("user_id long, event_id long, ts timestamp, value double").parquet(f"{tmp_path}/e")
    got = sorted(r.event_id for r in twins.finished(twins.alerts(stream), "alerts").collect())
    assert got == ([1, 3, 5] if first else [])
    schema = "url string, event_id long, ts timestamp, http_status int, stock_status string, price double"
    states = [("u", 1, t(0), 200, "in_stock", None), ("u", 2, t(1), None, None, 5.0), ("u", 3, t(2), 200, "in_stock", 9.0), ("u", 4, t(3), 200, None, None), ("u", 5, t(4), 200, "in_stock", 4.0)]
    spark.createDataFrame(states, schema).coalesce(1).write.parquet(f"{tmp_path}/w")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/w")
    got = {r.event_id: r.event for r in twins.finished(twins.watch(stream), "watch").collect()}
    batch = {r.event_id: r.event for r in changes.watch_events(spark.createDataFrame(states, schema), "url", ["ts", "event_id"]).collect()}
    assert got == batch == {3: "published", 4: "sold_out", 5: "purchasable"}


def test_blocking_without_caps(spark):
    """700 offers of one set, above the cap: none pair with it, and all compatible ones without; alike ones are one row."""
    kind = "id long, stable_key string, game string, set_code string, product_type string, name_key string, tokens array<string>, name string"
    rows = [(i, f"s{i}", "g" if i % 5 else None, "set", f"t{i % 3}" if i % 4 else None, f"k{i % 90}", ["common", f"k{i % 90}"], f"n{i}") for i in range(700)]
    c = spark.createDataFrame(rows, kind)
    fits = lambda a, b: all(x is None or y is None or x == y for x, y in zip(a[2:5], b[2:5]))
    free = resolve.Scoring(max_bucket=None, max_postings=None, max_candidates=None, max_token_ratio=1.0)
    shares = lambda a, b: (a[2] == b[2]) or a[5] == b[5]
    got = [tuple(r) for r in resolve.block_pairs(c, free).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and shares(a, b) and fits(a, b)}
    buckets = collections.defaultdict(list)
    for r in rows:
        for key in (("type", *r[2:5]), ("set", r[2]), ("name", r[5])):
            buckets[key].append(r)
    met = {(a[0], b[0]) for bucket in buckets.values() if len(bucket) <= 300 for a in bucket for b in bucket if a[0] < b[0] and fits(a, b)}
    assert {tuple(r) for r in resolve.block_pairs(c).collect()} == met < set(got)
    got = [tuple(r) for r in resolve.rare_token_pairs(c, free).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and fits(a, b)}

    one, members = resolve.contracted(c)
    first = {}
    for r in rows:
        first.setdefault((r[2], r[3], r[4], r[5]), r[0])
    assert {r.id for r in one.collect()} == set(first.values())
    assert {tuple(r) for r in members.collect()} == {(r[0], first[r[2], r[3], r[4], r[5]]) for r in rows}
    none = c.limit(0)
    assert not resolve.block_pairs(none, free).count() and not resolve.contracted(none)[1].count()


def test_chains_follow_the_last_taken_row(spark):
    import numpy as np

    from pricegrain.operators import chains, history

    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = spark.createDataFrame([(1, t(10 * i), 5.0, "d") for i in range(13)] + [(2, t(0), None, "d"), (2, t(1), 5.0, "e"), (2, t(2), None, "f"), (2, t(3), 5.0, "g"), (2, t(4), 6.0, "h"), (2, t(28), 6.0, "h"), (2, t(29), 6.0, "i"), (2, None, 1.0, "a")], "k long, seen_at timestamp, price double, digest string")
    kept = lambda **k: sorted((r.k, r.seen_at or t(-1)) for r in history.snapshots(rows, ["k"], ["seen_at"], **k).collect())
    assert kept() == [(1, t(30 * i)) for i in range(5)] + [(2, t(h)) for h in (-1, 1, 4, 28)]
    assert kept(digest="digest") == [(1, t(0))] + [(2, t(h)) for h in (-1, 1, 4, 29)]
    rng = np.random.default_rng(1)
    for size in (1, 7, 400):
        at, force = np.sort(rng.integers(0, 50, size)), rng.random(size) < 0.1
        force[0] = True
        want, last = [], None
        for i in range(size):
            want.append(bool(force[i]) or at[i] >= last + 5)
            last = at[i] if want[-1] else last
        for cut in (size, size // 3):  # in one batch, in two
            a, mid = chains.taken(at[:cut], force[:cut], -(10**9), 5)
            b, end = chains.taken(at[cut:], force[cut:], mid, 5)
            assert [*a, *b] == want and end == last
