"""Constrained grouping for components of any size: the greedy order of all edges, followed where it can make a difference."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricegrain.operators.graph import min_labels
from pricegrain.operators.storage import discard, written

#: Edges of a component that one task goes through; a component with more is taken in blocks of the order.
BLOCK = 200_000
#: Kinds of rows in a component's stream, in the order in which they come.
NODE, APART, EDGE = 0, 1, 2


def _order() -> list[Column | str]:
    """The order of the edges."""
    return ["stage", F.desc("score"), "a", "b"]


class _Groups:
    """Union-find over one component, with the values that each group knows and the groups it must not join."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.values: dict[int, list[str | None]] = {}
        self.apart: dict[int, set[int]] = {}
        self.size: dict[int, int] = {}

    def add(self, node: int, values: list[str | None]) -> None:
        self.parent[node], self.values[node], self.size[node] = node, list(values), 1

    def separate(self, p: int, q: int) -> None:
        if p in self.parent and q in self.parent:
            self.apart.setdefault(p, set()).add(q)
            self.apart.setdefault(q, set()).add(p)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, p: int, q: int) -> bool | None:
        """Whether two nodes' groups were joined; None if they were one already. The sets of separated groups are kept by root:
        the smaller one moves, so the work is that of the pairs times the logarithm of the groups."""
        r, s = self.root(p), self.root(q)
        if r == s:
            return None
        if s in self.apart.get(r, ()) or any(v is not None and w is not None and v != w for v, w in zip(self.values[r], self.values[s])):
            return False
        weight = lambda g: self.size[g] + len(self.apart.get(g, ()))
        if weight(r) < weight(s):
            r, s = s, r
        self.parent[s] = r
        self.size[r] += self.size.pop(s)
        self.values[r] = [v if v is not None else w for v, w in zip(self.values[r], self.values.pop(s))]
        for other in self.apart.pop(s, ()):
            self.apart[other].discard(s)
            self.apart[other].add(r)
            self.apart.setdefault(r, set()).add(other)
        return True


def settle(nodes: DataFrame, apart: DataFrame, edges: DataFrame) -> DataFrame:
    """The greedy order in each component: rows (kind 'group': id and its group, the smallest of its nodes), ('joined': an edge
    that joined two groups), ('refused': one that would have held two values or a separated pair).

    nodes (component, id, values array<string>), apart (component, p, q), edges (component, p, q, a, b, stage, score,
    method): p and q are the nodes that a and b, the offers, stand in; they are the same but where groups of earlier blocks
    are the nodes. Components are dealt to tasks and sorted, so a task streams through many and holds one at a time.
    """
    none = lambda kind: F.lit(None).cast(kind)
    stream = (
        nodes.select("component", F.lit(NODE).alias("kind"), F.col("id").alias("p"), none("long").alias("q"), "values", none("long").alias("a"), none("long").alias("b"), none("int").alias("stage"), none("double").alias("score"), none("string").alias("method"))
        .unionByName(apart.select("component", F.lit(APART).alias("kind"), "p", "q"), allowMissingColumns=True)
        .unionByName(edges.select("component", F.lit(EDGE).alias("kind"), "p", "q", "a", "b", "stage", "score", "method"), allowMissingColumns=True)
    )
    sent = stream.select("component", "kind", "p", F.coalesce("q", F.lit(0)).alias("q"), "values", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("stage", F.lit(0)).alias("stage"), F.coalesce("score", F.lit(0.0)).alias("score"), "method")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.repartition(n, "component").sortWithinPartitions("component", "kind", *_order())
    columns = ["kind", "id", "group", "a", "b", "stage", "score", "method"]

    def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, own, out = None, _Groups(), []

        def closed() -> list[tuple]:
            least: dict[int, int] = {}
            for i in own.parent:
                r = own.root(i)
                least[r] = min(i, least.get(r, i))
            return [("group", i, least[own.root(i)], 0, 0, 0, 0.0, None) for i in own.parent]

        for pdf in batches:
            for component, kind, p, q, values, a, b, stage, score, method in pdf.itertuples(index=False, name=None):
                if component != current:
                    out += closed()
                    current, own = component, _Groups()
                if kind == NODE:
                    own.add(p, values)
                elif kind == APART:
                    own.separate(p, q)
                else:
                    joined = own.join(p, q)
                    if joined is not None:
                        out.append(("joined" if joined else "refused", 0, 0, a, b, stage, score, method))
            if out:
                yield pd.DataFrame(out, columns=columns, dtype=object)
                out = []
        if own.parent:
            yield pd.DataFrame(closed(), columns=columns, dtype=object)

    return dealt.mapInPandas(greedy, "kind string, id long, group long, a long, b long, stage int, score double, method string")


def _positions(rows: DataFrame, order: list[Column | str], tag: str) -> DataFrame:
    """rows with nth (from 0) in an order over all of them, without one task that holds them: ranges of the order are sorted
    side by side, and each begins where those before it end."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), tag)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a range
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = ranged.withColumn("_own", F.row_number().over(W.partitionBy("_range").orderBy(*order)))
    return numbered.join(F.broadcast(starts), "_range").withColumn("nth", F.col("_start") + F.col("_own") - 1).drop("_range", "_own", "_start")


def _in_blocks(nodes: DataFrame, apart: DataFrame, edges: DataFrame, block: int) -> DataFrame:
    """settle for components of more edges than a task should hold: the order is cut into blocks of so many edges. The groups
    that the blocks before have made are the nodes of the next, with what they know, so each block's components are no
    larger than the block. The blocks come one after another, as the order demands."""
    placed = _positions(edges, _order(), "ordered")
    total = placed.agg(F.max("nth")).first()[0]
    groups = written(nodes.select("id", F.col("id").alias("group"), "values"), "state")
    one_value = [F.max(F.get("values", F.lit(i))) for i in range(len(nodes.select("values").first()[0]))]
    found = []
    for k in range(0, (total or 0) + 1, block):
        where = groups.select("id", "group")
        own = placed.filter(F.col("nth").between(k, k + block - 1)).join(where.toDF("a", "p"), "a").join(where.toDF("b", "q"), "b").filter("p <> q").drop("component", "nth")
        own = written(own, "block")
        labels = min_labels(own, "p", "q")
        known = groups.groupBy("group").agg(F.array(*one_value).alias("values"))  # a group knows one value of an attribute at most
        here = known.join(labels.toDF("group", "component"), "group").select("component", F.col("group").alias("id"), "values")
        blocked = apart.select("p", "q").join(where.toDF("p", "g"), "p").join(where.toDF("q", "h"), "q").filter("g <> h").select(F.col("g").alias("p"), F.col("h").alias("q")).distinct()
        blocked = blocked.join(labels.toDF("p", "component"), "p").join(labels.toDF("q", "other"), "q").filter("component = other")
        solved = written(settle(here, blocked, own.join(labels.toDF("p", "component"), "p")), "settled")
        found.append(solved.filter("kind <> 'group'"))
        moved = solved.filter("kind = 'group'").select(F.col("id").alias("group"), F.col("group").alias("into"))
        after = written(groups.join(moved, "group", "left").select("id", F.coalesce("into", "group").alias("group"), "values"), "state")
        discard(groups, own)
        groups = after
    ends = groups.select(F.lit("group").alias("kind"), "id", "group", *(F.lit(None).cast(t).alias(c) for c, t in (("a", "long"), ("b", "long"), ("stage", "int"), ("score", "double"), ("method", "string"))))
    for x in found:
        ends = ends.unionByName(x)
    return ends


def grouped(nodes: DataFrame, apart: DataFrame, edges: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups (id, group), joined edges (a, b, stage, score, method), refused edges) as the greedy order over all edges makes them.

    nodes (id, values array<string>), apart (a, b), edges (a, b, stage, score, method). A component of edges in which no two
    values differ, no pair is separated and no human has decided (stage 1) is one group, of whatever size, and is not gone
    through. Of the others, those of at most block edges are streamed, each within a task; larger ones are taken in blocks.
    Nodes without edges are not in the result. In a component that is not gone through only the edges that came first at
    either end count as joined.
    """
    edges = written(edges, "edges")
    labels = min_labels(edges)
    inside = edges.join(labels.toDF("a", "component"), "a")
    held = nodes.join(labels.toDF("id", "component"), "id")
    own_apart = apart.join(labels.toDF("a", "component"), "a").join(labels.toDF("b", "other"), "b").filter("component = other").select("component", F.col("a").alias("p"), F.col("b").alias("q"))
    n_values = max((len(r[0]) for r in nodes.select("values").limit(1).collect()), default=0)
    differ = F.lit(False)
    for i in range(n_values):
        value = F.get("values", F.lit(i))
        differ = differ | F.coalesce(F.min(value) != F.max(value), F.lit(False))
    mixed = held.groupBy("component").agg(differ.alias("mixed"))
    sizes = inside.groupBy("component").agg(F.count("*").alias("n"), F.max(F.col("stage") == 1).alias("decided"))
    parts = own_apart.select("component").distinct().withColumn("parted", F.lit(True))
    kinds = written(
        sizes.join(mixed, "component").join(parts, "component", "left")
        .select("component", F.when(~F.col("mixed") & ~F.col("decided") & F.col("parted").isNull(), "free").when(F.col("n") <= block, "small").otherwise("large").alias("size")), "kinds",
    )
    of = lambda df, size: df.join(kinds.filter(F.col("size") == size).select("component"), "component", "left_semi")

    free = of(inside, "free")
    ends = free.select(F.explode(F.array("a", "b")).alias("id"), F.struct("stage", (-F.col("score")).alias("s"), "a", "b", "method").alias("e"))
    first = ends.groupBy("id").agg(F.min("e").alias("e")).select("e.*").distinct().select("a", "b", "stage", (-F.col("s")).alias("score"), "method")
    free_groups = of(held, "free").select("id", F.col("component").alias("group"))

    small_edges = of(inside, "small").withColumns({"p": F.col("a"), "q": F.col("b")})
    solved = written(settle(of(held, "small"), of(own_apart, "small"), small_edges), "settled")
    if not kinds.filter("size = 'large'").isEmpty():
        large = written(of(held, "large"), "large")
        solved = solved.unionByName(_in_blocks(large, of(own_apart, "large"), of(inside, "large"), block))
    edge = ["a", "b", "stage", "score", "method"]
    groups = free_groups.unionByName(solved.filter("kind = 'group'").select("id", "group"))
    return groups, first.unionByName(solved.filter("kind = 'joined'").select(edge)), solved.filter("kind = 'refused'").select(edge)


def first_come(ranked: DataFrame, group_col: str, choice: str = "product_id", nth: str = "nth") -> DataFrame:
    """(group, choice): in the order of the groups, each takes the first of its choices, by nth, that no group before it took.

    Groups that share no choice, directly or through others, do not influence one another, so each component of groups and
    choices is gone through by itself: sorted, one row at a time, with the taken choices alone in memory. A long chain of
    groups that displace each other costs no more than its rows.
    """
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    links = ranked.select(name("g", group_col).alias("a"), name("p", choice).alias("b"))
    labels = min_labels(links).filter(F.col("node").startswith("g"))
    rows = ranked.withColumn("node", name("g", group_col)).join(labels, "node").select("component", F.col(group_col).alias("g"), F.col(nth).alias("nth"), F.col(choice).alias("p"))
    n = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = [ranked.schema[c].dataType.simpleString() for c in (group_col, choice)]

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        component, served, used = None, None, set()
        for pdf in batches:
            out = []
            for c, g, _, p in pdf.itertuples(index=False, name=None):
                if c != component:
                    component, served, used = c, None, set()
                if g != served and p not in used:
                    used.add(p)
                    served = g
                    out.append((g, p))
            if out:
                yield pd.DataFrame(out, columns=[group_col, choice], dtype=object)

    return rows.repartition(n, "component").sortWithinPartitions("component", "g", "nth").mapInPandas(take, f"{group_col} {kinds[0]}, {choice} {kinds[1]}")
