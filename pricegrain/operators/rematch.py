"""Matching again after some offers changed: only new pairs are scored, only components that something touched are grouped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrain.operators import resolve
from pricegrain.operators.graph import min_labels
from pricegrain.operators.storage import written


@dataclass(frozen=True)
class Match:
    """A finished matching: every scored pair, the edges and separations it was grouped by, the assignment; and what came of it."""

    scored: DataFrame
    edges: DataFrame
    different: DataFrame
    assignment: DataFrame
    reviews: DataFrame
    n_scored: int
    n_grouped: int


def match(candidates: DataFrame, same: DataFrame, different: DataFrame, stats: tuple[DataFrame, int], cfg: resolve.Scoring = resolve.Scoring()) -> Match:
    """All of it. stats: what resolve.token_stats gave, of these candidates or of earlier ones."""
    none = candidates.select("id").limit(0)
    schema = "a long, b long, score double, method string, breakdown string"
    empty = candidates.sparkSession.createDataFrame([], schema)
    edges = candidates.sparkSession.createDataFrame([], "a long, b long, stage int, score double, method string")
    blank = candidates.sparkSession.createDataFrame([], "id long, product_key long, method string, score double")
    start = Match(empty, edges, none.select(F.col("id").alias("a"), F.col("id").alias("b")), blank, empty, 0, 0)
    return rematch(start, candidates, candidates.select("id"), same, different, stats, cfg)


def rematch(before: Match, candidates: DataFrame, changed: DataFrame, same: DataFrame, different: DataFrame, stats: tuple[DataFrame, int], cfg: resolve.Scoring = resolve.Scoring()) -> Match:
    """The matching of candidates, from that before the offers of changed (id) came, changed or went: what match would give.

    Candidate pairs are found anew, since an offer may push another out of a third one's list; that needs no Python. Of
    them only those of a changed offer, or that were not scored before, are scored. An edge is touched if it came, went or
    has another score; components (of the old and the new edges together) with a touched edge, a changed offer or a
    changed separation are grouped again, and all others keep their groups. stats must be those of the matching before:
    with others every score may change, which is a new match.
    """
    ids = changed.select("id").distinct().withColumn("_changed", F.lit(True))
    pairs = written(resolve.candidate_pairs(candidates, cfg, stats), "pairs")
    marked = pairs.join(ids.withColumnsRenamed({"id": "a", "_changed": "_a"}), "a", "left").join(ids.withColumnsRenamed({"id": "b", "_changed": "_b"}), "b", "left")
    still = marked.filter("_a IS NULL AND _b IS NULL").select("a", "b")
    kept = before.scored.join(still, ["a", "b"], "left_semi")
    to_score = written(pairs.join(kept.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    fresh = resolve.score_pairs(candidates, to_score, cfg, stats)
    scored = written(kept.unionByName(fresh.select(kept.columns)), "scored")
    edges = written(resolve.edges_of(candidates, scored, same, different, cfg), "edges")

    columns = ["a", "b", "stage", "score", "method"]
    old, new = before.edges.select(columns), edges.select(columns)
    moved = old.exceptAll(new).unionByName(new.exceptAll(old)).select("a", "b")
    apart = lambda d: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    parted = apart(before.different).exceptAll(apart(different)).unionByName(apart(different).exceptAll(apart(before.different)))
    ends = lambda d: d.select(F.explode(F.array("a", "b")).alias("id"))
    touched = ends(moved).unionByName(ends(parted)).unionByName(ids.select("id")).distinct()
    labels = written(min_labels(old.unionByName(new)).toDF("id", "component"), "labels")
    again = written(labels.join(labels.join(touched, "id", "left_semi").select("component").distinct(), "component", "left_semi").select("id").unionByName(touched).distinct(), "again")
    here = candidates.join(again, "id", "left_semi")
    part = resolve.assigned(here, edges.join(again.select(F.col("id").alias("a")), "a", "left_semi"), different, cfg)[0]
    untouched = before.assignment.join(again, "id", "left_anti").join(candidates.select("id"), "id", "left_semi")
    assignment = written(untouched.select(part.columns).unionByName(part), "groups")
    return Match(scored, edges, different, assignment, resolve.reviews_of(scored, assignment, different, cfg), to_score.count(), here.count())
