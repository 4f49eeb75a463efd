"""MinHash near-dedup (7): universal hash minima and banding find candidates, signatures and whole sets confirm them, stars join them to components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrain.llm.chunks import in_batches
from pricegrain.llm.common import LOWER, UPPER, discard, hot_support, id_type, materialize
from pricegrain.llm.components import components
from pricegrain.llm.rolling import mix, numbers, range_hashes

WORDS, ROWS = 5, 6
#: Chance that a pair exactly at the threshold shares no band.
MISS = 1e-6
#: Members of a bucket that are compared in one task with one another, or with as many others.
BLOCK = 1024
#: Characters that are shingled at once: some 60 bytes of a Python worker's memory each.
BATCH = 300_000
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_U = np.uint64


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def shingle_sets(texts: list[str], size: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; of the whole word sequence where it is shorter; none without words."""
    parts = [t.encode().translate(_LOWER) for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    edges = np.cumsum([0, *(len(p) + 1 for p in parts)])
    word = ~_SPACES[data]
    starts = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]]))
    ends = np.flatnonzero(word & np.concatenate([~word[1:], [True]])) + 1
    hashes = range_hashes(data, starts, ends, 7)
    weights = numbers(size, 11)
    of = np.searchsorted(starts, edges)
    n = len(hashes) - size + 1
    rolled = np.zeros(max(n, 0), dtype=_U)
    for i in range(size if n > 0 else 0):
        rolled += hashes[i : i + n] * weights[i]
    rolled = mix(rolled)
    out = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            out.append(mix((hashes[a:b] * weights[: b - a]).sum(keepdims=True) + _U(b - a)))
        else:
            out.append(np.empty(0, dtype=_U))
    return out


def minima(sets: list[np.ndarray], k: int) -> np.ndarray:
    """Minima of k universal hashes a * x + b modulo 2**64 over each (non-empty) set [sets, k]."""
    a, b = numbers(k, 21), numbers(k, 22)
    out = np.empty((len(sets), k), dtype=_U)
    for start, own in in_batches(sets, 1 << 15):
        x = np.concatenate(own)
        at = np.cumsum([0, *map(len, own[:-1])])
        h = np.empty_like(x)
        for i in range(k):
            np.multiply(x, a[i], out=h)
            np.add(h, b[i], out=h)
            out[start : start + len(own), i] = np.minimum.reduceat(h, at)
    return out


def _signed(docs: DataFrame, bands: int) -> DataFrame:
    """(_id, n, s1, s2, bands, sketch): size and 128-bit digest of the set, band keys, and a byte of each minimum."""
    own_id, sent, kind = id_type(docs, "_id")

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start, own in in_batches(pdf["_text"].tolist(), BATCH):
                sets = shingle_sets(own)
                full = [i for i, s in enumerate(sets) if len(s)]
                mins = mix(minima([sets[i] for i in full], bands * ROWS)) if full else np.empty((0, bands * ROWS), _U)
                keyed = (mins.reshape(len(full), bands, ROWS) * numbers(ROWS, 31)).sum(2)
                keyed = mix(keyed + np.arange(1, bands + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)).view(np.int64)
                sketch = (mins >> _U(56)).astype(np.uint8)
                band, byte = [None] * len(own), [None] * len(own)
                for j, i in enumerate(full):
                    band[i], byte[i] = keyed[j], sketch[j].tobytes()
                yield pd.DataFrame({
                    "_id": pdf["_id"].iloc[start : start + len(own)].to_numpy(), "n": [len(s) for s in sets],
                    "s1": [int(s.sum().view(np.int64)) if len(s) else 0 for s in sets], "s2": [int(mix(s + _U(5)).sum().view(np.int64)) if len(s) else 0 for s in sets],
                    "bands": band, "sketch": byte,
                })

    signed = docs.withColumn("_id", own_id).mapInPandas(sign, f"_id {sent}, n long, s1 long, s2 long, bands array<long>, sketch binary")
    return signed.withColumn("_id", F.col("_id").cast(kind))


def _sets(docs: DataFrame) -> DataFrame:
    kind = docs.schema["_id"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start, own in in_batches(pdf["_text"].tolist(), BATCH):
                yield pd.DataFrame({"_id": pdf["_id"].iloc[start : start + len(own)].to_numpy(), "shingles": [s.tobytes() for s in shingle_sets(own)]})

    return docs.mapInPandas(read, f"_id {kind}, shingles binary")


def _least_matches(threshold: float, k: int) -> int:
    """Equal bytes of two sketches below which the sets cannot be that similar (five standard deviations)."""
    return math.floor(k * (threshold - 5 * math.sqrt(threshold * (1 - threshold) / k)))


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _matches(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="int64")
    x, y = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).sum(1))


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each (key, part), of partitions that are sorted by them."""
    rest: pd.DataFrame | None = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        new = np.flatnonzero((pdf["key"].to_numpy()[1:] != pdf["key"].to_numpy()[:-1]) | (pdf["part"].to_numpy()[1:] != pdf["part"].to_numpy()[:-1])) + 1
        edges = [0, *new.tolist()]
        for a, b in zip(edges[:-1], edges[1:]):
            yield pdf.iloc[a:b]
        rest = pdf.iloc[edges[-1] :]
    if rest is not None and len(rest):
        yield rest


def _close_pairs(group: pd.DataFrame, least: int, labels: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, later rows of another label whose sketch is close); labels may change meanwhile. Rows of side 0 and 1 meet one
    another; where all are of side 2, all meet."""
    sketch = np.frombuffer(b"".join(group["sketch"]), dtype=np.uint8).reshape(len(group), -1)
    side = group["side"].to_numpy()
    for i in range(len(group) - 1):
        later = np.flatnonzero((labels[i + 1 :] != labels[i]) & ((side[i + 1 :] != side[i]) | (side[i] == 2))) + i + 1
        for at in range(0, len(later), 4096):
            part = later[at : at + 4096]
            close = part[(sketch[part] == sketch[i]).sum(1) >= least]
            if len(close):
                yield i, close


def _met(rows: DataFrame) -> DataFrame:
    """rows (key, _id, comp, ...) so that every two of a key meet in one (key, part): a large key is cut into blocks, and
    each row is sent to the pairs of blocks that its own is one of."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("m"))
    blocks = rows.join(sizes, "key").withColumn("g", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("_id"), "g").cast("int"))
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.withColumn("part", (F.least("own", "other") * F.col("g") + F.greatest("own", "other")).cast("int"))
    return dealt.withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)).drop("m", "g", "own", "other")


def _in_groups(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "part").sortWithinPartitions("key", "part", "_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    A document's set are its distinct shingles of five words (words: runs of anything but white space, A-Z lower-cased);
    fewer words make one shingle, no words (null text too) an empty set, which is linked with nothing. Two are linked if
    100 * intersection >= percent * union; component_id is the smallest id reachable by links, kept tells the rows that
    have it. Rows that share an id are copies of one document as long as their texts are alike; ids should be unique. An
    empty table gives no rows; other columns are ignored, whatever their names.

    Equal sets are found by digest and stand for one. Buckets of a band link each member to the smallest first (as many
    candidates as rows, checked by signature, then on the whole sets). What is then left are buckets that hold several
    components: their members are compared by signature and whole set, pairs that are already joined left out, and only
    the links that join two components go on. Buckets of any size are gone through, large ones block by block, so the
    only links that can be missed are those that share no band (MISS at the threshold) or whose signatures differ by
    five standard deviations more than expected.
    """
    threshold = percent / 100
    bands = bands_for(threshold)
    least = _least_matches(threshold, bands * ROWS)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    signed = materialize(_signed(texts, bands), "signatures")
    reps = materialize(signed.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("_id").alias("rep"), F.count("*").alias("copies")), "classes")
    first = materialize(signed.join(reps.select(F.col("rep").alias("_id")).distinct(), "_id", "left_semi").filter("n > 0").dropDuplicates(["_id"]).select("_id", "bands", "sketch"), "first")

    keyed = first.select("_id", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("_id").alias("center")).filter("m > 1").drop("m")
    members = materialize(keyed.join(buckets, "key"), "buckets")
    involved = members.select("_id").distinct()
    sketches = first.select("_id", "sketch").join(involved, "_id", "left_semi")

    # each member against the smallest of its bucket
    stars = members.filter("_id <> center").select("_id", "center").distinct()
    matches = F.pandas_udf(_matches, "long")
    close = materialize(
        stars.join(sketches, "_id").join(sketches.select(F.col("_id").alias("center"), F.col("sketch").alias("other")), "center").filter(matches("sketch", "other") >= least).select("_id", "center"), "close"
    )
    # the ids grow with the documents, so they are not broadcast, few as they may be; texts are shuffled once
    sets = materialize(_sets(texts.join(involved.hint("merge"), "_id", "left_semi").dropDuplicates(["_id"])), "sets")

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_similar(np.frombuffer(x, _U), np.frombuffer(y, _U), percent) for x, y in zip(a, b)], dtype=bool)

    links = materialize(
        close.join(sets, "_id").join(sets.select(F.col("_id").alias("center"), F.col("shingles").alias("others")), "center").filter(linked("shingles", "others")).select(F.col("_id").alias("a"), F.col("center").alias("b")), "links"
    )
    joined = components(links).withColumnRenamed("node", "_id")

    # buckets of several components: members that are close to one of another component, then the links between them
    labelled = members.select("key", "_id").join(joined, "_id", "left").withColumn("comp", F.coalesce("component", "_id")).drop("component")
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    kind = docs.schema[id_col].dataType.simpleString()
    open_rows = materialize(labelled.join(mixed, "key", "left_semi"), "mixed")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches):
            hit = np.zeros(len(group), dtype=bool)
            for i, close_ones in _close_pairs(group, least, group["comp"].to_numpy()):
                hit[i] = hit[close_ones] = True
            if hit.any():
                yield group.loc[hit, ["key", "_id", "comp"]]

    candidates = _in_groups(_met(open_rows.join(sketches, "_id"))).select("key", "part", "_id", "comp", "sketch", "side")
    hits = materialize(candidates.mapInPandas(near, f"key long, _id {kind}, comp {kind}").distinct(), "near")

    def join_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches):
            ids, labels = group["_id"].tolist(), group["comp"].to_numpy().copy()
            own = [np.frombuffer(x, _U) for x in group["shingles"]]
            found = []
            for i, close_ones in _close_pairs(group, least, labels):
                for j in close_ones.tolist():
                    if labels[i] != labels[j] and _similar(own[i], own[j], percent):
                        found.append((ids[i], ids[j]))
                        labels[labels == labels[j]] = labels[i]
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    full = _in_groups(_met(hits.join(sketches, "_id").join(sets, "_id"))).select("key", "part", "_id", "comp", "sketch", "side", "shingles")
    more = materialize(full.mapInPandas(join_up, f"a {kind}, b {kind}").distinct(), "links")
    final = components(links.unionByName(more)).withColumnsRenamed({"node": "rep"})
    discard(first, members, close, sets, links, open_rows, hits, more)  # what is returned reads the signatures and the components

    classes = materialize(reps.join(final, "rep", "left").select("n", "s1", "s2", "copies", F.coalesce("component", "rep").alias("component")), "classes")
    discard(reps)
    rows = signed.select("_id", "n", "s1", "s2")
    # sets of very many copies meet their component in a broadcast, at most 1 / share of them; empty sets meet nothing
    total = signed.agg(F.count("*")).first()[0]
    hot = classes.filter(F.col("copies") > hot_support(docs.sparkSession) * total).select("n", "s1", "s2", F.col("component").alias("hot"))
    met = rows.filter("n > 0").join(F.broadcast(hot), ["n", "s1", "s2"], "left")
    cold = met.filter("hot IS NULL").drop("hot").join(classes.drop("copies"), ["n", "s1", "s2"], "left").select("_id", "n", "component")
    out = cold.unionByName(met.filter("hot IS NOT NULL").select("_id", "n", F.col("hot").alias("component"))).unionByName(rows.filter("n = 0").select("_id", "n", F.col("_id").alias("component")))
    out = out.withColumn("component_id", F.coalesce("component", "_id"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
