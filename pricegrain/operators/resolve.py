"""Offers of one product: blocking, scores of pairs, constrained groups, review queue."""

from __future__ import annotations

import hashlib
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricegrain.functions.parse import stable_key
from pricegrain.functions.similarity import jaccard, name_similarity
from pricegrain.operators import grouping
from pricegrain.operators.graph import min_labels
from pricegrain.operators.market import inverse_document_frequency, majority
from pricegrain.operators.storage import ordered_pair, upsert, written


#: Rows of a key that one task pairs with as many others: larger keys are split into cells.
CELL = 300

#: Pairs that one task of pair_cosines puts out, about: their number grows with the square of a key's rows, and so do the tasks.
TASK_PAIRS = 50_000_000


@dataclass(frozen=True)
class Scoring:
    """M11. Weights, penalties and thresholds of a pair's score, of 100."""

    auto: float = 90.0
    review: float = 75.0
    w_identifier: float = 100.0
    w_set: float = 20.0
    w_type: float = 25.0
    w_quantity: float = 15.0
    w_tokens: float = 20.0
    w_name: float = 20.0
    w_language: float = 5.0
    p_quantity: float = -30.0
    p_language: float = -30.0
    p_distinctive: float = -14.0
    most_distinctive: float = -42.0
    unknown_credit: float = 0.35
    unknown_cap: float = 88.0
    language_is_identity: bool = True
    rare_ratio: float = 0.02
    min_confidence: float = 0.7
    # caps of the blocking; None lifts one, so that no pair is lost on large tables
    max_bucket: int | None = 300
    max_postings: int | None = 400
    always_rare: int = 60
    max_token_ratio: float = 0.25
    max_candidates: int | None = 80

    @property
    def identity(self) -> list[str]:
        return ["set_code", "product_type", *(["language"] if self.language_is_identity else [])]


#: (token, df, idf) and the number of offers.
Stats = tuple[DataFrame, int]


def token_stats(candidates: DataFrame) -> Stats:
    """How frequent the tokens are, written once for all that need it: blocking, vectors, rare tokens."""
    idf, n = inverse_document_frequency(candidates, "id", "tokens")
    return written(idf, "idf"), n


def load_candidates(offers: DataFrame, stores: DataFrame, identifiers: DataFrame) -> DataFrame:
    """The active offers as candidates. tokens is a JSON list; where it is none, or empty, the words of the normalised name, or
    else of the name, take its place. gtins and mpns are the sets of an offer's identifiers (offer_id, kind,
    normalized_value); the key is the shop's code with the offer's own id, or else its address.

    offers: id, store_id, external_id, url, name, normalized_name, tokens, name_key, is_active, quantity_confidence and the
    attributes; stores: store_id, store_code.
    """
    kinds = identifiers.filter(F.col("kind").isin("gtin", "mpn")).groupBy(F.col("offer_id").alias("id")).agg(
        *(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("normalized_value")))).alias(f"{k}s") for k in ("gtin", "mpn"))
    )
    none = F.array().cast("array<string>")
    given = F.coalesce(F.from_json("tokens", "array<string>"), none)
    words = F.filter(F.split(F.coalesce(F.nullif("normalized_name", F.lit("")), "name", F.lit("")), r"\s+"), lambda w: w != "")
    rows = offers.filter("is_active").join(stores.select("store_id", "store_code"), "store_id").join(kinds, "id", "left")
    return rows.select(
        "id", "store_id", "store_code", stable_key("store_code", "external_id", "url").alias("stable_key"), "name", F.when(F.size(given) > 0, given).otherwise(words).alias("tokens"), F.coalesce("name_key", F.lit("")).alias("name_key"),
        "game", "set_code", "product_type", "units_total", F.coalesce("quantity_confidence", F.lit(0.0)).alias("quantity_confidence"), "language", F.coalesce("gtins", none).alias("gtins"), F.coalesce("mpns", none).alias("mpns"),
    )


def tfidf_vectors(rows: DataFrame, key: str, tokens: str, stats: Stats | None = None) -> DataFrame:
    """M8: (key, vector map<string,double>) of unit length; tf is the share of the tokens, idf ln((N + 1) / (df + 1)) + 1. Tokens
    that given stats do not know have no weight."""
    idf, _ = stats or inverse_document_frequency(rows, key, tokens)
    counts = rows.select(key, F.size(tokens).alias("_n"), F.explode(tokens).alias("token")).groupBy(key, "_n", "token").agg(F.count("*").alias("_c"))
    weighted = counts.join(idf, "token").withColumn("_w", F.col("_c") / F.col("_n") * F.col("idf"))
    return weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_l"), F.collect_list(F.struct("token", "_w")).alias("_v")).select(
        key, F.map_from_entries(F.transform("_v", lambda x: F.struct(x["token"], x["_w"] / F.col("_l")))).alias("vector")
    )


def cosine(a: Column, b: Column) -> Column:
    """Of two maps of unit length; 0 where either is null."""
    return F.coalesce(F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + a[k] * F.coalesce(b[k], F.lit(0.0))), F.lit(0.0))


def compatible(a: str = "a", b: str = "b") -> Column:
    """No attribute that both know and that differs."""
    out = F.lit(True)
    for c in ("game", "set_code", "product_type"):
        out = out & F.coalesce(F.col(f"{a}.{c}") == F.col(f"{b}.{c}"), F.lit(True))
    return out


def met_in_cells(rows: DataFrame, key: str, size: str, values: list[str]) -> DataFrame:
    """Rows a and b (structs of id and values) that share a key, each pair once for each key, a.id < b.id.

    size is the key's number of rows. Its rows are dealt to about size / CELL parts by a hash of the id and each two parts
    meet in a cell of their own, so that the work of a very frequent key is spread over tasks of bounded size.
    """
    parts = F.ceil(F.col(size) / CELL).cast("int")
    dealt = rows.select(F.col(key).alias("_key"), F.struct("id", *values).alias("_row"), parts.alias("_parts")).withColumn("_part", F.pmod(F.xxhash64("_row.id"), F.col("_parts")).cast("int"))
    a = dealt.select("_key", F.col("_row").alias("a"), F.col("_part").alias("_low"), F.explode(F.sequence(F.col("_part"), F.col("_parts") - 1)).alias("_high"))
    b = dealt.select("_key", F.col("_row").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_part"))).alias("_low"), F.col("_part").alias("_high"))
    met = a.join(b, ["_key", "_low", "_high"]).filter((F.col("a.id") < F.col("b.id")) | ((F.col("_low") < F.col("_high")) & (F.col("a.id") > F.col("b.id"))))
    turned = F.col("a.id") > F.col("b.id")
    return met.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"))


def pair_cosines(rows: DataFrame, stats: Stats | None = None) -> DataFrame:
    """M8: (a, b, cosine), a < b, for all pairs of rows (id, key, tokens) of one key; a key of null pairs with nothing.

    Rows of a key with the same tokens are one class: vectors meet once for each two classes, rows without tokens are like
    none. Ids are kept in lists of about CELL and each two lists of a key meet in a row of their own, so that all that is done
    for a pair of ids is to write it, and no task holds more than its own rows. The rows of two lists are small for what comes
    out of them, so they are dealt to tasks by the number of pairs, not by their bytes.
    """
    stats = stats or inverse_document_frequency(rows, "id", "tokens")
    c = rows.filter("id IS NOT NULL AND key IS NOT NULL").select("id", "key", F.coalesce(F.array_sort("tokens"), F.array().cast("array<string>")).alias("words"))
    total = c.groupBy("key").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    cores = c.sparkSession.sparkContext.defaultParallelism
    tasks = cores * max(1, math.ceil(total / TASK_PAIRS / cores))
    sizes = c.groupBy("key", "words").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    dealt = c.join(sizes, ["key", "words"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    cells = dealt.groupBy("key", "words", "part").agg(F.collect_list("id").alias("ids"))
    kinds = sizes.join(tfidf_vectors(sizes.select("words").distinct(), "words", "words", stats), "words", "left").withColumn("id", F.col("words"))
    kinds = kinds.join(kinds.groupBy("key").agg(F.count("*").alias("n")), "key")
    unlike = met_in_cells(kinds, "key", "n", ["key", "parts", "vector"])
    own = F.struct("id", "key", "parts", "vector")
    met = unlike.unionByName(kinds.select(own.alias("a"), own.alias("b"))).select(
        F.col("a.key").alias("key"), F.col("a.id").alias("x"), F.col("b.id").alias("y"), F.round(cosine(F.col("a.vector"), F.col("b.vector")), 6).alias("cosine"), F.col("a.parts").alias("_n"), F.col("b.parts").alias("_m"),
    )
    spread = met.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("q", F.explode(F.sequence(F.when(F.col("x") == F.col("y"), F.col("p")).otherwise(0), F.col("_m") - 1))).drop("_n", "_m")
    left = cells.select("key", F.col("words").alias("x"), F.col("part").alias("p"), F.col("ids").alias("_left"))
    right = cells.select("key", F.col("words").alias("y"), F.col("part").alias("q"), F.col("ids").alias("_right"))
    two = spread.join(left, ["key", "x", "p"]).join(right, ["key", "y", "q"]).select("cosine", "_left", "_right", ((F.col("x") == F.col("y")) & (F.col("p") == F.col("q"))).alias("_same")).repartition(tasks)
    pairs = two.select("cosine", "_same", "_right", F.explode("_left").alias("_i")).select("cosine", "_same", "_i", F.explode("_right").alias("_j")).filter(F.when(F.col("_same"), F.col("_i") < F.col("_j")).otherwise(F.col("_i") != F.col("_j")))
    return pairs.select(F.least("_i", "_j").alias("a"), F.greatest("_i", "_j").alias("b"), "cosine")


def block_pairs(candidates: DataFrame, cfg: Scoring = Scoring()) -> DataFrame:
    """(a, b), a < b, of one bucket: game, set and type; game and set; equal name_key. Buckets above max_bucket don't
    pair; with None all do."""
    key = lambda kind, *cols: F.concat_ws("\x01", F.lit(kind), *(F.coalesce(c, F.lit("\x02")) for c in cols))
    keys = F.array(
        F.when(F.col("set_code").isNotNull(), key("type", "game", "set_code", "product_type")), F.when(F.col("set_code").isNotNull(), key("set", "game", "set_code")),
        F.when(F.col("name_key") != "", key("name", "name_key")),
    )
    attributes = ["game", "set_code", "product_type"]
    rows = candidates.select("id", *attributes, F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n >= 2")
    if cfg.max_bucket is not None:
        sizes = sizes.filter(F.col("n") <= cfg.max_bucket)
    return met_in_cells(rows.join(sizes, "key"), "key", "n", attributes).filter(compatible()).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def rare_token_pairs(candidates: DataFrame, cfg: Scoring = Scoring(), stats: Stats | None = None) -> DataFrame:
    """(a, b), a < b: for each candidate the max_candidates others with which it shares most, by the summed IDF
    of rare tokens; then the compatible ones. A token is usable if few have it, by number or share, and max_postings at
    most. None lifts a cap: all others that share a usable token."""
    idf, n = stats or token_stats(candidates)
    usable = idf.filter((F.col("df") >= 2) & ((F.col("df") <= cfg.always_rare) | (F.col("df") <= cfg.max_token_ratio * n)))
    if cfg.max_postings is not None:
        usable = usable.filter(F.col("df") <= cfg.max_postings)
    postings = candidates.select("id", F.explode(F.array_distinct("tokens")).alias("token")).join(usable, "token")
    shared = met_in_cells(postings, "token", "df", ["idf"]).groupBy(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id")).agg(F.sum("a.idf").alias("weight"))
    if cfg.max_candidates is None:
        pairs = shared.select("a_id", "b_id")
    else:
        each = shared.select(F.explode(F.array(F.struct(F.col("a_id").alias("id"), F.col("b_id").alias("other")), F.struct(F.col("b_id").alias("id"), F.col("a_id").alias("other")))).alias("p"), "weight").select("p.*", "weight")
        # sums of the same weights may differ in their last bits
        best = each.withColumn("_nth", F.row_number().over(W.partitionBy("id").orderBy(F.round("weight", 9).desc(), "other"))).filter(F.col("_nth") <= cfg.max_candidates)
        pairs = best.select(F.least("id", "other").alias("a_id"), F.greatest("id", "other").alias("b_id")).distinct()
    attributes = candidates.select("id", "game", "set_code", "product_type")
    met = pairs.join(attributes.alias("a"), F.col("a_id") == F.col("a.id")).join(attributes.alias("b"), F.col("b_id") == F.col("b.id")).filter(compatible())
    return met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def contracted(candidates: DataFrame, apart: tuple[str, ...] = ("id", "stable_key", "name")) -> tuple[DataFrame, DataFrame]:
    """(one candidate, the smallest id, of all that are alike but for the columns apart; members (id, stands_for)).

    Blocking without caps pairs these only: very many copies of one offer are one row, and their links are the members.
    """
    same = [c for c in candidates.columns if c not in apart]
    marked = candidates.withColumn("_alike", F.sha2(F.to_json(F.struct(*same)), 256))
    first = marked.groupBy("_alike").agg(F.min("id").alias("stands_for"))
    members = marked.select("id", "_alike").join(first, "_alike").select("id", "stands_for")
    return candidates.join(members.filter("id = stands_for").select("id"), "id", "left_semi"), members


def candidate_pairs(candidates: DataFrame, cfg: Scoring = Scoring(), stats: Stats | None = None) -> DataFrame:
    """M13."""
    return block_pairs(candidates, cfg).unionByName(rare_token_pairs(candidates, cfg, stats)).distinct()


def score_pairs(candidates: DataFrame, pairs: DataFrame, cfg: Scoring = Scoring(), stats: Stats | None = None) -> DataFrame:
    """Pairs (a, b) with score, method and breakdown (JSON).

    What is cheap decides first: identifiers, hard rejects, and an upper bound of the score from the attributes and the
    tokens' Jaccard. Only pairs that may still reach the review threshold come to the text measures, which need Python.
    """
    stats = stats or token_stats(candidates)
    idf, n = stats
    rare = idf.filter(F.col("df") <= cfg.rare_ratio * n).select("token")
    marked = candidates.select("id", F.explode(F.array_distinct("tokens")).alias("token")).join(rare, "token").groupBy("id").agg(F.collect_set("token").alias("rare"))
    full = candidates.join(tfidf_vectors(candidates, "id", "tokens", stats), "id", "left").join(marked, "id", "left")
    both = pairs.join(full.alias("x"), F.col("a") == F.col("x.id")).join(full.alias("y"), F.col("b") == F.col("y.id"))
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    differ = lambda c: F.coalesce(x(c) != y(c), F.lit(False))
    same = lambda c: F.coalesce(x(c) == y(c), F.lit(False))
    shared = lambda c: F.size(F.array_intersect(F.coalesce(x(c), F.array().cast("array<string>")), F.coalesce(y(c), F.array().cast("array<string>")))) > 0
    sure = lambda s: F.when(F.col(f"{s}.quantity_confidence") >= cfg.min_confidence, F.col(f"{s}.units_total"))

    staged = both.withColumns({
        "_gtin": shared("gtins"), "_mpn": shared("mpns"),
        "_reject": differ("game") | differ("set_code") | differ("product_type") | (differ("language") if cfg.language_is_identity else F.lit(False)),
        "_qa": sure("x"), "_qb": sure("y"), "_jaccard": jaccard(x("tokens"), y("tokens")), "_same_set": same("set_code"), "_same_type": same("product_type"),
    })
    qa, qb = F.col("_qa"), F.col("_qb")

    def known(p: Column, q: Column, weight: float) -> tuple[Column, Column]:
        """(earned, applicable): full if both are known (and then equal), a share if one is."""
        return (
            F.when(p.isNotNull() & q.isNotNull(), weight).when(p.isNotNull() | q.isNotNull(), weight * cfg.unknown_credit).otherwise(0.0),
            F.when(p.isNotNull() | q.isNotNull(), weight).otherwise(0.0),
        )

    set_e, set_a = known(x("set_code"), y("set_code"), cfg.w_set)
    type_e, type_a = known(x("product_type"), y("product_type"), cfg.w_type)
    unequal = F.coalesce(qa != qb, F.lit(False))
    qty_e, qty_a = known(qa, qb, cfg.w_quantity)
    languages = x("language").isNotNull() & y("language").isNotNull()
    staged = staged.withColumns({
        "_earned": set_e + type_e + F.when(unequal, 0.0).otherwise(qty_e) + F.when(languages & same("language"), cfg.w_language).otherwise(0.0),
        "_applicable": set_a + type_a + qty_a + F.when(languages, cfg.w_language).otherwise(0.0),
        "_penalty": F.when(unequal, cfg.p_quantity).otherwise(0.0) + F.when(differ("language"), cfg.p_language).otherwise(0.0),
    })
    text_weight = cfg.w_tokens + cfg.w_name
    staged = staged.withColumn("_bound", 100 * (F.col("_earned") + cfg.w_tokens * F.col("_jaccard") + cfg.w_name) / (F.col("_applicable") + text_weight) + F.col("_penalty"))
    staged = staged.withColumn("_how", F.when(F.col("_gtin"), "gtin").when(F.col("_reject"), "reject").when(~F.col("_mpn") & (F.col("_bound") < cfg.review), "bound").otherwise("text"))

    blank = F.lit(None).cast("struct<combined:double,distinctive:array<string>>")
    early = staged.filter("_how <> 'text'").withColumns({
        "score": F.when(F.col("_how") == "gtin", cfg.w_identifier).when(F.col("_how") == "reject", 0.0).otherwise(F.greatest(F.lit(0.0), F.col("_bound"))),
        "method": F.when(F.col("_how") == "gtin", "EAN_MATCH").otherwise("FUZZY_MATCH"), "_text": blank,
    })

    tokens = lambda s: F.array_distinct(F.col(f"{s}.tokens"))
    telling = lambda s: F.coalesce(F.col(f"{s}.rare"), F.array().cast("array<string>"))
    own = lambda s, o: F.filter(F.array_except(tokens(s), tokens(o)), lambda t: t.contains("_") | t.rlike("^[A-Za-z]$") | F.array_contains(telling(s), t))
    late = staged.filter("_how = 'text'").withColumn("_names", name_similarity(x("tokens"), y("tokens"), cosine(x("vector"), y("vector")))).withColumn("_distinct", F.concat(own("x", "y"), own("y", "x")))
    raw = 100 * (F.col("_earned") + cfg.w_tokens * F.col("_jaccard") + cfg.w_name * F.col("_names.combined")) / (F.col("_applicable") + text_weight)
    raw = raw + F.col("_penalty") + F.greatest(F.lit(cfg.most_distinctive), cfg.p_distinctive * F.size("_distinct"))
    raw = F.when(F.col("_mpn"), F.greatest(raw, F.lit(cfg.auto + 5))).otherwise(raw)
    bare = x("set_code").isNull() & y("set_code").isNull() & x("product_type").isNull() & y("product_type").isNull()
    raw = F.when(bare & ~x("name_key").eqNullSafe(y("name_key")), F.least(raw, F.lit(cfg.unknown_cap))).otherwise(raw)
    raw = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))
    by_name = ~F.col("_mpn") & (x("name_key") != "") & same("name_key")
    late = late.withColumns({
        "score": F.when(by_name, F.greatest(raw, F.lit(95.0))).otherwise(raw),
        "method": F.when(F.col("_mpn"), "SKU_MATCH").when(by_name, "NAME_MATCH").when(F.col("_same_set") & F.col("_same_type") & qa.eqNullSafe(qb), "ATTRIBUTE_MATCH").otherwise("FUZZY_MATCH"),
        "_text": F.struct(F.col("_names.combined").alias("combined"), F.col("_distinct").alias("distinctive")),
    })
    breakdown = F.to_json(F.struct(F.col("_how").alias("decided_by"), F.round("_earned", 2).alias("earned"), F.round("_applicable", 2).alias("applicable"), F.col("_penalty").alias("penalty"), F.round("_jaccard", 3).alias("token_overlap"), F.round("_text.combined", 3).alias("name_similarity"), F.col("_text.distinctive").alias("distinctive")))
    shape = lambda df: df.select("a", "b", F.round("score", 2).alias("score"), "method", breakdown.alias("breakdown"))
    return shape(early).unionByName(shape(late))


def gtin_edges(candidates: DataFrame) -> DataFrame:
    """Each offer with a GTIN against the first offer that has it.

    The first offers are one row for each GTIN of several offers and are hashed; the offers go by them unsorted. Pairs are made
    distinct only where equal ones have met, by tasks that are more than the cores: a task holds a small part of them.
    """
    rows = candidates.select("id", F.explode("gtins").alias("gtin"))
    first = rows.groupBy("gtin").agg(F.min("id").alias("anchor"), F.max("id").alias("last")).filter("anchor <> last").drop("last")
    met = rows.join(first.hint("shuffle_hash"), "gtin").filter("id <> anchor").select(F.col("anchor").alias("a"), F.col("id").alias("b"))
    spark = candidates.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    return met.repartition(n, "a", "b").distinct()


def keyed_pairs(decisions: DataFrame, keys: DataFrame, decision: str) -> DataFrame:
    """The offers that the keys of human decisions stand for; decisions about offers that are gone drop out."""
    own = keys.select("id", "stable_key")
    named = decisions.filter(F.col("decision") == decision)
    joined = named.join(own.select(F.col("id").alias("p"), F.col("stable_key").alias("a_key")), "a_key").join(own.select(F.col("id").alias("q"), F.col("stable_key").alias("b_key")), "b_key")
    return joined.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).filter("a <> b").distinct()


def edges_of(candidates: DataFrame, scored: DataFrame, same: DataFrame, different: DataFrame, cfg: Scoring = Scoring()) -> DataFrame:
    """The edges (a, b, stage, score, method) between known offers: GTIN, human decision, scores from auto on."""
    edges = (
        gtin_edges(candidates).select("a", "b", F.lit(0).alias("stage"), F.lit(100.0).alias("score"), F.lit("EAN_MATCH").alias("method"))
        .unionByName(same.select("a", "b", F.lit(1).alias("stage"), F.lit(100.0).alias("score"), F.lit("MANUAL").alias("method")))
        .unionByName(scored.filter(F.col("score") >= cfg.auto).select("a", "b", F.lit(2).alias("stage"), "score", "method").join(different, ["a", "b"], "left_anti"))
    )
    known = candidates.select("id")
    return edges.join(known.toDF("a"), "a", "left_semi").join(known.toDF("b"), "b", "left_semi").select(edges.columns)


def assigned(candidates: DataFrame, edges: DataFrame, different: DataFrame, cfg: Scoring = Scoring(), block: int = grouping.BLOCK) -> tuple[DataFrame, DataFrame]:
    """(assignment (id, product_key, method, score), refused edges)."""
    nodes = candidates.select("id", F.array(*(F.col(c).cast("string") for c in cfg.identity)).alias("values"))
    apart = different.unionByName(different.select(F.col("b").alias("a"), F.col("a").alias("b")))
    groups, joined, refused = grouping.grouped(nodes, apart, edges, block)
    # what joined an offer: a human if one did, else the first edge, whose score is the highest
    ends = joined.select(F.explode(F.array("a", "b")).alias("id"), F.struct((F.col("stage") != 1).alias("m"), "stage", (-F.col("score")).alias("s"), "a", "b", "method").alias("e"))
    how = ends.groupBy("id").agg(F.min("e").alias("e")).select("id", F.col("e.method").alias("method"), (-F.col("e.s")).alias("score"))
    placed = candidates.select("id").join(groups, "id", "left").join(how, "id", "left")
    return written(placed.select("id", F.coalesce("group", "id").alias("product_key"), F.coalesce("method", F.lit("SINGLETON")).alias("method"), F.coalesce("score", F.lit(100.0)).alias("score")), "groups"), refused


def reviews_of(scored: DataFrame, assignment: DataFrame, different: DataFrame, cfg: Scoring = Scoring()) -> DataFrame:
    """Pairs from the review threshold on that ended in different groups and that no human has separated."""
    where = assignment.select("id", "product_key")
    open_pairs = scored.filter(F.col("score") >= cfg.review).join(different, ["a", "b"], "left_anti")
    return open_pairs.join(where.toDF("a", "pa"), "a").join(where.toDF("b", "pb"), "b").filter("pa <> pb").select("a", "b", "score", "method", "breakdown")


def group(candidates: DataFrame, scored: DataFrame, same: DataFrame, different: DataFrame, cfg: Scoring = Scoring(), block: int = grouping.BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assignment, reviews, conflicts).

    assignment (id, product_key, method, score): the group's smallest offer and what joined the offer. Unions go by GTIN,
    human decision, then falling score (ties by ids); one is refused that would hold two values of an identity attribute or
    a pair that a human has separated. grouping.grouped follows that order, in components of any size. Reviews are pairs
    from the review threshold on that ended in different groups and that no human has separated. conflicts: decisions
    'same' that a separation overruled.
    """
    assignment, refused = assigned(candidates, edges_of(candidates, scored, same, different, cfg), different, cfg, block)
    return assignment, reviews_of(scored, assignment, different, cfg), refused.filter("stage = 1").select("a", "b")


def keep_ids(assignment: DataFrame, old: DataFrame, group_col: str = "product_key") -> DataFrame:
    """(product_key, product_id): in the order of their keys, each group takes the old product that most of its offers
    had (of several the smallest) and that no group before it took; null for a new product. Groups and the products they
    ask for are gone through by components, see grouping.first_come."""
    votes = assignment.join(old.select("id", "product_id").filter("product_id IS NOT NULL"), "id").groupBy(group_col, "product_id").agg(F.count("*").alias("n"))
    ranked = written(votes.withColumn("nth", F.row_number().over(W.partitionBy(group_col).orderBy(F.desc("n"), "product_id"))).drop("n"), "votes")
    return assignment.select(group_col).distinct().join(grouping.first_come(ranked, group_col), group_col, "left")


def forget_pairs(decisions: DataFrame, ours: DataFrame, theirs: DataFrame, decision: str = "different") -> DataFrame:
    """Decisions without those that hold a key of ours apart from one of theirs, whichever side they are on. The
    pairs are not made: a decision is looked up once on each side."""
    a = ours.select(F.col("stable_key").alias("k"), F.lit(1).alias("ours")).distinct()
    b = theirs.select(F.col("stable_key").alias("k"), F.lit(1).alias("theirs")).distinct()
    side = a.join(b, "k", "full")
    out = decisions
    for c in ("a", "b"):
        out = out.join(side.select(F.col("k").alias(f"{c}_key"), F.col("ours").alias(f"_{c}1"), F.col("theirs").alias(f"_{c}2")), f"{c}_key", "left")
    across = (F.col("_a1").isNotNull() & F.col("_b2").isNotNull()) | (F.col("_a2").isNotNull() & F.col("_b1").isNotNull())
    return out.filter(~(across & (F.col("decision") == decision))).select(decisions.columns)


def fingerprint(candidates: DataFrame, cfg: Scoring = Scoring()) -> str:
    """Digest of all that a pair's score depends on: every candidate's own columns, in any order, and the settings."""
    listed = [F.array_join(F.array_sort(F.col(c)), ",") if c in ("gtins", "mpns") else F.array_join(c, " ") if c == "tokens" else F.col(c).cast("string") for c in ("id", "name_key", "tokens", "game", "set_code", "product_type", "language", "units_total", "quantity_confidence", "gtins", "mpns")]
    row = F.concat_ws("|", *(F.coalesce(c, F.lit("\x00")) for c in listed))
    half = lambda seed: F.sum(F.xxhash64(row, F.lit(seed)).cast("decimal(38,0)")).cast("string")
    n, one, two = candidates.agg(F.count("*"), half(1), half(2)).first()
    return hashlib.sha256(f"{n}|{one}|{two}|{sorted(asdict(cfg).items())}".encode()).hexdigest()


def cached_scores(candidates: DataFrame, folder: str, cfg: Scoring = Scoring()) -> DataFrame:
    """The pairs' scores, computed and written below the folder once for each fingerprint of their inputs, then read."""
    spark = candidates.sparkSession
    path = f"{folder}/{fingerprint(candidates, cfg)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        score_pairs(candidates, candidate_pairs(candidates, cfg), cfg).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def breakdown_of(text: Column | str) -> Column:
    """A review's breakdown as a map of texts; what is no JSON object is an empty one."""
    col = F.col(text) if isinstance(text, str) else text
    whole = F.try_parse_json(col).isNotNull() & F.ltrim(col).startswith("{")
    return F.coalesce(F.when(whole, F.from_json(col, "map<string,string>")), F.create_map().cast("map<string,string>"))


def sync_reviews(queue: DataFrame, found: DataFrame, assignment: DataFrame, active: DataFrame) -> DataFrame:
    """Pending pairs that are no longer found, lie in one group or lost an offer go; new ones come; decided ones stay as they are."""
    where = assignment.select("id", "product_key")
    apart = queue.join(where.toDF("a", "pa"), "a", "left").join(where.toDF("b", "pb"), "b", "left").filter("NOT (pa <=> pb) OR pa IS NULL").select(queue.columns)
    live = apart.join(active.select(F.col("id").alias("a")), "a", "left_semi").join(active.select(F.col("id").alias("b")), "b", "left_semi").select(queue.columns)
    decided = live.filter("status <> 'pending'")
    fresh = found.join(decided.select("a", "b"), ["a", "b"], "left_anti").withColumn("status", F.lit("pending")).select(queue.columns)
    return decided.unionByName(fresh)


def close_implied(queue: DataFrame, same: DataFrame) -> DataFrame:
    """Pending pairs inside one component of the decisions 'same' are confirmed."""
    labels = min_labels(same)
    joined = queue.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
    return joined.withColumn("status", F.when((F.col("status") == "pending") & F.coalesce(F.col("la") == F.col("lb"), F.lit(False)), "confirmed").otherwise(F.col("status"))).select(queue.columns)


def merge_allowed(products: DataFrame, pairs: DataFrame, cfg: Scoring = Scoring()) -> DataFrame:
    """Pairs of products with what forbids to merge them: identity attributes that both know and that differ."""
    x, y = products.alias("x"), products.alias("y")
    joined = pairs.join(x, F.col("p") == F.col("x.product_id")).join(y, F.col("q") == F.col("y.product_id"))
    clashes = F.filter(F.array(*(F.when(F.col(f"x.{c}") != F.col(f"y.{c}"), F.lit(c)) for c in cfg.identity)), lambda c: c.isNotNull())
    return joined.select("p", "q", clashes.alias("clashes"), (F.size(clashes) == 0).alias("allowed"))


def separate(offer: DataFrame, offers: DataFrame) -> DataFrame:
    """Decisions 'different' of an offer against every other of its product."""
    a, b = offer.alias("a"), offers.alias("b")
    joined = a.join(b, (F.col("a.product_id") == F.col("b.product_id")) & (F.col("a.stable_key") != F.col("b.stable_key")))
    return joined.select(F.least("a.stable_key", "b.stable_key").alias("a_key"), F.greatest("a.stable_key", "b.stable_key").alias("b_key"), F.lit("different").alias("decision")).distinct()


def rejoin(decisions: DataFrame, keys: DataFrame) -> DataFrame:
    """M21d-f: without the decisions 'different' that a key of keys takes part in."""
    own = keys.select(F.col("stable_key").alias("k"))
    apart = F.col("decision") == "different"
    kept = decisions.filter(apart).join(own, F.col("a_key") == F.col("k"), "left_anti").join(own, F.col("b_key") == F.col("k"), "left_anti")
    return decisions.filter(~apart).unionByName(kept)


def products_of(candidates: DataFrame, assignment: DataFrame) -> DataFrame:
    """A2 over groups: one row of majority attributes for each product."""
    rows = candidates.join(assignment.select("id", "product_key"), "id")
    out = rows.select("product_key").distinct()
    for c in ("game", "set_code", "product_type", "language"):
        out = out.join(majority(rows, "product_key", c, "id"), "product_key", "left")
    return out


def decision_sides(decisions: DataFrame, keys: DataFrame) -> DataFrame:
    """Each decision with the offers its keys stand for; a side whose offer is gone has none and is marked."""
    a, b = (keys.select(F.col("stable_key").alias(f"{s}_key"), F.col("id").alias(s)) for s in ("a", "b"))
    joined = decisions.join(a, "a_key", "left").join(b, "b_key", "left")
    return joined.select(*decisions.columns, "a", "b", F.col("a").isNull().alias("a_missing"), F.col("b").isNull().alias("b_missing"))


def save_decisions(decisions: DataFrame, new: DataFrame, at: str = "decided_at") -> DataFrame:
    """New decisions replace those about the same two keys, whichever way round they are given; of several new ones
    about a pair the last stays (of one time, the greatest word)."""
    x, y = ordered_pair("a_key", "b_key")
    keyed = new.withColumns({"a_key": x, "b_key": y})
    last = keyed.groupBy("a_key", "b_key").agg(F.max(F.struct(at, "decision")).alias("_v")).select("a_key", "b_key", "_v.*")
    return upsert(decisions, last, ["a_key", "b_key"])


def forget_decisions(decisions: DataFrame, queue: DataFrame, keys: DataFrame, forgotten: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M21e, M21f: (decisions, queue) without the forgotten decisions (a_key, b_key); the reviews of their pairs, whichever
    way round, wait again."""
    gone = forgotten.select("a_key", "b_key").distinct()
    left = decisions.join(gone, ["a_key", "b_key"], "left_anti").select(decisions.columns)
    found = decision_sides(decisions.join(gone, ["a_key", "b_key"], "left_semi"), keys).select("a", "b")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("_open", F.lit(True))
    reviews = queue.join(both, ["a", "b"], "left").withColumn("status", F.when(F.col("_open"), "pending").otherwise(F.col("status")))
    return left, reviews.select(queue.columns)


def merge_products(candidates: DataFrame, scored: DataFrame, decisions: DataFrame, assignment: DataFrame, wanted: DataFrame, at: Column, cfg: Scoring = Scoring()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M21b in one step: (decisions, assignment, outcome) after the products wanted (p, q) have been made one.

    A pair whose attributes clash changes nothing (M22). For the others, decisions that hold an offer of one apart from one of
    the other go (J16), 'same' is decided between their smallest offers (K11), and the groups are made again (M14). outcome
    (p, q, allowed, merged) is the verification: whether all offers of both are one product now. An allowed pair may still
    stay apart, where a third offer or decision stands between. decisions: a_key, b_key, decision, decided_at, by stable
    keys; an offer that is gone takes part in nothing. wanted: any number of pairs; a pair of one product with itself, or
    with one that is not there, is left out. Null keys meet nothing.
    """
    lookup = candidates.select("id", "stable_key")
    placed = lookup.join(assignment.select("id", "product_key"), "id")
    products = products_of(candidates, assignment).withColumnRenamed("product_key", "product_id")
    checked = written(merge_allowed(products, wanted.select("p", "q").filter("p <> q").distinct(), cfg), "checked")
    pair = checked.filter("allowed").select(F.least("p", "q").alias("_p"), F.greatest("p", "q").alias("_q")).distinct()

    side = lambda s: placed.select(F.col("stable_key").alias(f"{s}_key"), F.col("product_key").alias(f"_{s}"))
    sided = decisions.join(side("a"), "a_key", "left").join(side("b"), "b_key", "left").withColumns({"_p": F.least("_a", "_b"), "_q": F.greatest("_a", "_b")})
    met = sided.join(pair.withColumn("_met", F.lit(True)), ["_p", "_q"], "left")
    left = met.filter((F.col("decision") != "different") | F.col("_met").isNull()).select(decisions.columns)
    key = lambda c, out: lookup.select(F.col("id").alias(c), F.col("stable_key").alias(out))
    new = pair.join(key("_p", "a_key"), "_p").join(key("_q", "b_key"), "_q").select("a_key", "b_key", F.lit("same").alias("decision"), at.alias("decided_at"))
    decided = written(save_decisions(left, new), "decided")

    sides = decision_sides(decided, lookup).filter("NOT a_missing AND NOT b_missing")
    ids = lambda d: sides.filter(F.col("decision") == d).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    apart = ids("different")
    after = assigned(candidates, edges_of(candidates, scored, ids("same"), apart, cfg), apart, cfg)[0]
    ends = placed.join(after.select("id", F.col("product_key").alias("_now")), "id").groupBy("product_key").agg(F.min("_now").alias("lo"), F.max("_now").alias("hi"))
    one = (F.col("x.lo") == F.col("x.hi")) & (F.col("y.lo") == F.col("y.hi")) & (F.col("x.lo") == F.col("y.lo"))
    joined = checked.join(ends.alias("x"), F.col("p") == F.col("x.product_key")).join(ends.alias("y"), F.col("q") == F.col("y.product_key"))
    return decided, after, joined.select("p", "q", "allowed", one.alias("merged"))


#: Attributes of an offer that may be corrected by hand.
EDITABLE = ("language", "set_code", "product_type", "url")


def refused_overrides(changes: DataFrame) -> DataFrame:
    """Corrections of other attributes, and addresses that are no web addresses."""
    url = (F.col("attribute") == "url") & ~F.coalesce(F.ltrim("value").rlike("^https?://"), F.lit(True))
    return changes.filter(~F.col("attribute").isin(*EDITABLE) | (url & (F.col("value") != "")))


def set_overrides(overrides: DataFrame, changes: DataFrame) -> DataFrame:
    """Corrections (entity_key, attribute, value) after changes, one of a key and attribute; null takes one back. What
    refused_overrides finds changes nothing."""
    valid = changes.join(refused_overrides(changes).select("entity_key", "attribute"), ["entity_key", "attribute"], "left_anti")
    valid = valid.withColumn("value", F.when(F.col("attribute") == "url", F.trim("value")).otherwise(F.col("value")))
    return upsert(overrides, valid.select(overrides.columns), ["entity_key", "attribute"]).filter("value IS NOT NULL")


def with_overrides(extracted: DataFrame, overrides: DataFrame, key: str = "stable_key") -> DataFrame:
    """J13, M21g: offers, as extracted from their names, with the corrections put over; so an offer whose correction was
    taken back has again what its name says. An empty language means none; other empty values change nothing. The address
    is the offer's identity and stays: a corrected one is shown_url."""
    one = lambda a: F.max(F.when(F.col("attribute") == a, F.col("value"))).alias(f"_{a}")
    wide = overrides.groupBy(F.col("entity_key").alias(key)).agg(*map(one, EDITABLE))
    joined = extracted.join(wide, key, "left")
    other = {c: F.coalesce(F.nullif(f"_{c}", F.lit("")), c) for c in ("set_code", "product_type")}
    language = F.when(F.col("_language").isNotNull(), F.nullif("_language", F.lit(""))).otherwise(F.col("language"))
    return joined.withColumns(other | {"language": language, "shown_url": F.coalesce(F.nullif("_url", F.lit("")), "url")}).drop(*(f"_{a}" for a in EDITABLE)).select(*extracted.columns, "shown_url")
