"""Offsets, exactly-once writing, stored tables in parts and timers: restarts, failures, what is left alone."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from pricegrain.operators import parts
from pricegrain.sources import numbered
from pricegrain.streaming import once, terms, twins


def answer(spark, root, n, rows, done=True):
    spark.createDataFrame(rows, "k long, v string").coalesce(2).write.json(f"{root}/{numbered.NAME.format(n)}")
    if not done:
        os.remove(f"{root}/{numbered.NAME.format(n)}/_SUCCESS")


def test_numbered_answers_survive_restarts(spark, tmp_path):
    numbered.register(spark)
    root, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    load = lambda r: r.format("numbered_answers").schema("k long, v string").option("path", root).option("ack", f"{tmp_path}/ack").load()
    assert load(spark.read).count() == 0
    run = lambda: load(spark.readStream).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    got = lambda: sorted(r.k for r in spark.read.schema("k long, v string").parquet(out).collect())
    answer(spark, root, 0, [(1, "a"), (2, None)])
    answer(spark, root, 1, [(3, "ü\n")])
    answer(spark, root, 3, [(7, "late one before me")])
    run()
    assert got() == [1, 2, 3]
    run()
    assert got() == [1, 2, 3]  # nothing new: answer 2 is awaited
    answer(spark, root, 2, [(5, "x")])
    answer(spark, root, 4, [(9, "unfinished")], done=False)
    with open(f"{root}/{numbered.NAME.format(2)}/part-x.json", "w") as f:
        f.write('nonsense\n[1]\n{"k": 6}\n')
    run()
    assert got() == [1, 2, 3, 5, 6, 7] and '"next": 2' in open(f"{tmp_path}/ack").read()
    assert sorted(r.k for r in load(spark.read).collect()) == got()


def test_published_once_after_failures(spark, tmp_path):
    src, box, book = f"{tmp_path}/in", f"{tmp_path}/box", f"{tmp_path}/book"
    spark.createDataFrame([(i % 40, i) for i in range(100)], "key long, v long").write.parquet(f"{src}/a")
    stream = lambda: spark.readStream.schema("key long, v long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(src)
    sent = []

    def fail(at):
        def send(rows, name):
            sent.append((name, sorted(r.key for r in rows.collect())))
            if len(sent) in at:
                raise RuntimeError("between sending and entering")
        return send

    start = lambda state, send: once.publish_once(stream(), "key", book, box, f"{tmp_path}/{state}", send).start().awaitTermination()
    with pytest.raises(Exception, match="between"):
        start("s1", fail({1}))
    start("s1", fail(set()))
    spark.createDataFrame([(i, i) for i in range(30, 50)], "key long, v long").write.parquet(f"{src}/b")
    with pytest.raises(Exception, match="between"):
        start("s1", fail({len(sent) + 1}))
    start("s1", fail(set()))
    assert sent[0] == sent[1]  # the same batch, by the same name
    start("s2", fail(set()))  # another query over the same input finds all entered
    for path in (box, book):
        keys = [r.key for r in once.entries(spark, path, "key long").collect()]
        assert sorted(keys) == sorted(set(keys)) == list(range(50))


def files_of(path):
    return {p: sorted(f for f in os.listdir(f"{path}/{p}") if f.endswith(".parquet")) for p in os.listdir(path) if p.startswith(parts.PART)}


def test_parts_that_are_not_touched_keep_their_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    parts.create(spark.createDataFrame([(i, f"n{i}", "old") for i in range(200)], "k long, name string, note string"), path, ["k"], 16)
    before = files_of(path)
    new = spark.createDataFrame([(3, "x", "new"), (999, "y", "new")], "k int, name string, note string")
    parts.upsert_parts(spark, path, new, keep_old=["note"])
    after = files_of(path)
    assert len(before) == 16 and sum(before[p] != after[p] for p in before) in (1, 2)
    got = {r.k: (r.name, r.note) for r in parts.read(spark, path).collect()}
    assert len(got) == 201 and got[3] == ("x", "old") and got[999] == ("y", "new") and got[4] == ("n4", "old")
    parts.upsert_parts(spark, path, new.limit(0))
    assert files_of(path) == after
    parts.remove_parts(spark, path, spark.createDataFrame([(3,), (5,), (12345,)], "k long"))
    assert {r.k for r in parts.read(spark, path).collect()} == set(got) - {3, 5}
    lone, small = 10**6, f"{tmp_path}/u"
    parts.create(spark.createDataFrame([(lone, "a", "b")], "k long, name string, note string"), small, ["k"], 4)
    parts.remove_parts(spark, small, spark.createDataFrame([(lone,)], "k long"))
    assert not files_of(small)


def test_terms_end_without_a_row(spark, tmp_path):
    t = lambda d, h=0: dt.datetime(2024, 1, 1 + d, h)
    kind = "member_id long, event_id long, ts timestamp, kind string, days int"
    batches = [
        [(1, 1, t(0), "joined", 10), (1, 2, t(1), "joined", 10), (2, 3, t(1), "joined", 3), (4, 9, t(2), "left", 0)],
        [(9, 4, t(8), "other", 0)],
        [(1, 5, t(9), "renewed", 5), (9, 6, t(12), "other", 0)],
        [(2, 7, t(13), "joined", 9), (9, 8, t(20), "other", 0)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    begun = spark.createDataFrame([(3, t(5), t(0))], "member_id long, expires_at timestamp, since timestamp")
    got = twins.finished(terms.member_terms(stream, begun, steps=(7, 1)), "terms").collect()
    day = lambda r: (r.at / 1000 - t(0).replace(tzinfo=dt.UTC).timestamp()) / 86400
    found = sorted((r.member_id, day(r), r.action, r.step) for r in got)
    assert found == [
        (1, 0, "join", None), (1, 3, "remind", 7), (1, 9, "remind", 1), (1, 9, "renew", None), (1, 14, "remind", 1), (1, 15, "expire", None),
        (2, 1, "join", None), (2, 3, "remind", 1), (2, 4, "expire", None), (2, 13, "join", None), (2, 15, "remind", 7),
        (3, 4, "remind", 1), (3, 5, "expire", None),
    ]
    assert terms.due(100 * terms.DAY, 0, 200 * terms.DAY, [1, 7]) == [(93 * terms.DAY, "remind", 7), (99 * terms.DAY, "remind", 1), (100 * terms.DAY, "expire", None)]


def test_terms_go_to_the_state_many_at_once_and_begin_once(spark, tmp_path):
    t = lambda d: dt.datetime(2024, 1, 1 + d)
    kind = "member_id long, event_id long, ts timestamp, kind string, days int"
    rows = [(m, m, t(0), "joined", 3) for m in range(50)] + [(99, 100, t(20), "other", 0)]
    put = lambda name, own: spark.createDataFrame(own, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    begun = spark.createDataFrame([(m, t(9), t(0)) for m in (0, 70)], "member_id long, expires_at timestamp, since timestamp")

    def run():
        changes = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        found = terms.member_terms(changes, begun, steps=(1,))
        assert "FlatMapGroupsInPandasWithState" in found._jdf.queryExecution().analyzed().toString()
        found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return sorted((r.member_id, r.action) for r in spark.read.schema(terms.OUTPUT).parquet(f"{tmp_path}/out").collect())

    put("a", rows)
    joined = [(m, a) for m in range(1, 50) for a in ("expire", "join", "remind")]
    first = sorted([*joined, *((m, a) for m in (0, 70) for a in ("expire", "remind"))])
    assert run() == first
    put("b", [(1, 200, t(21), "renewed", 4), (99, 201, t(30), "other", 0)])
    assert run() == sorted([*first, (1, "renew"), (1, "remind"), (1, "expire")])
