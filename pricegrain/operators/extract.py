"""Attributes from canonical names: line of goods, edition, type, quantity, language; the name left without them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricegrain.functions import parse, text
from pricegrain.operators.market import content_hash

EMPTY = "array<string>"


@dataclass(frozen=True)
class ProductType:
    code: str
    name: str
    token: str
    specificity: int = 50
    units: int = 0
    confidence: float = 0.0
    unit_name: str | None = None


@dataclass(frozen=True)
class Catalog:
    """What attributes there are; plain data, sent with the plan."""

    #: token: (code, name)
    games: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: (pattern, game, code, name, is a series), in the order in which they are tried
    sets: Sequence[tuple[str, str, str, str, bool]] = ()
    types: Sequence[ProductType] = ()
    #: (pattern with one group, contents or multiplier, confidence), in order
    quantities: Sequence[tuple[str, str, float]] = ()
    blacklist: Sequence[int] = ()
    least: int = 1
    most: int = 500
    series_tokens: Sequence[str] = ()
    language_tokens: Sequence[str] = ()
    languages: dict[str, str] = field(default_factory=dict)

    def sets_in_order(self) -> list[tuple[str, str, str, str, bool]]:
        """Editions before series, more words first, then the longer pattern."""
        return sorted(self.sets, key=lambda s: (s[4], -len(s[0].split()), -len(s[0])))


def _table(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)) if pairs else F.create_map().cast("map<string,string>")


def label(code: Column, names: dict[str, str]) -> Column:
    """A code's name; one that has none passes."""
    return F.coalesce(_table(names)[code], code)


def detect_game(tokens: Column, hint: Column, catalog: Catalog) -> Column:
    """That of the first token that names one, else the hint."""
    table = _table({t: code for t, (code, _) in catalog.games.items()})
    return F.coalesce(F.try_element_at(F.filter(F.transform(tokens, lambda t: table[t]), lambda c: c.isNotNull()), F.lit(1)), hint)


def detect_set(basic: Column, game: Column, catalog: Catalog) -> Column:
    """Struct (game, code, name) of the first rule that hits, among those of the game where it is known."""
    tries = [F.when(basic.rlike(p) & F.coalesce(game == g, F.lit(True)), F.struct(F.lit(g).alias("game"), F.lit(c).alias("code"), F.lit(n).alias("name"))) for p, g, c, n, _ in catalog.sets_in_order()]
    return F.coalesce(*tries) if tries else F.lit(None).cast("struct<game:string,code:string,name:string>")


def detect_type(tokens: Column, catalog: Catalog) -> Column:
    """Code of the most specific type that a token names; of those alike, the first token's."""
    spec = _table({t.token: t.specificity for t in catalog.types}) if catalog.types else F.create_map().cast("map<string,int>")
    code = _table({t.token: t.code for t in catalog.types})
    named = F.filter(F.transform(tokens, lambda t, i: F.struct(spec[t].alias("s"), F.negative(i).alias("i"), code[t].alias("c"))), lambda x: x["s"].isNotNull())
    return F.array_max(named)["c"]


def detect_quantity(basic: Column, description: Column, kind: Column, catalog: Catalog) -> Column:
    """Struct (multiplier, units_total, confidence, source).

    The name's text goes before the description's, patterns in their order. A number on the blacklist or out of range
    passes to the next pattern, not to the next match. A multiplier that equals a type's own units says what it holds; else
    it multiplies them, and the result is as sure as the weaker of the two.
    """
    units = F.coalesce(_table({t.code: t.units for t in catalog.types})[kind], F.lit(0)).cast("int") if catalog.types else F.lit(0)
    sure = F.coalesce(_table({t.code: t.confidence for t in catalog.types})[kind], F.lit(0.0)).cast("double") if catalog.types else F.lit(0.0)
    make = lambda m, u, c, s: F.struct(m.cast("int").alias("multiplier"), u.cast("int").alias("units_total"), c.cast("double").alias("confidence"), F.lit(s).alias("source"))
    tries = []
    for source, where in (("name", basic), ("description", description)):
        for pattern, what, confidence in catalog.quantities:
            n = F.regexp_extract(where, pattern, 1).try_cast("int")
            good = n.between(catalog.least, catalog.most) & ~n.isin(*catalog.blacklist)
            if what == "contents":
                found = make(F.lit(1), n, F.lit(confidence), source)
            else:
                own = make(F.lit(1), units, F.greatest(F.lit(confidence), sure), source)
                total = make(n, F.when(units > 0, n * units).otherwise(n), F.when(units > 0, F.least(F.lit(confidence), sure)).otherwise(F.lit(confidence)), source)
                found = F.when((units > 1) & (n == units), own).otherwise(total)
            tries.append(F.when(good, found))
    tries.append(F.when(units > 0, make(F.lit(1), units, sure, "product_type_default")))
    return F.coalesce(*tries, make(F.lit(1), F.lit(None), F.lit(0.0), "unknown"))


def refine_tokens(core: Column, game: Column, set_code: Column, language: Column, kind: Column, catalog: Catalog) -> Column:
    """The core tokens without what the attributes already say; all of them where nothing would be left.

    Words of the game, of series (if the edition is known), of languages (if it is known), multipliers, and other types
    that hold no more units than the chosen one: those that hold more are the wrapping, and stay.
    """
    games = _table({t: code for t, (code, _) in catalog.games.items()})
    of, units = _table({t.token: t.code for t in catalog.types}), F.create_map(*(F.lit(x) for t in catalog.types for x in (t.code, t.units))) if catalog.types else F.create_map().cast("map<string,int>")
    no = F.lit(False)

    def stays(t: Column) -> Column:
        told = F.coalesce(games[t] == game, no) | (set_code.isNotNull() & t.isin(*catalog.series_tokens)) | (language.isNotNull() & t.isin(*catalog.language_tokens)) | t.rlike("^(x[0-9]{1,3}|[0-9]{1,3}x)$")
        return ~told & ~(F.coalesce(of[t] != kind, no) & (F.coalesce(units[of[t]], F.lit(0)) <= F.coalesce(units[kind], F.lit(0))))

    kept = F.filter(core, stays)
    return F.when(F.size(kept) > 0, kept).otherwise(core)


def canonical_name(found: Column, fallback: Column, catalog: Catalog) -> Column:
    """From the attributes if edition and type are known, else the fallback."""
    names = {t.code: t.name for t in catalog.types}
    full = F.concat_ws(" ", found["game_name"], found["set_name"], _table(names)[found["product_type"]], F.when(found["multiplier"] > 1, F.concat(F.lit("x"), found["multiplier"].cast("string"))), F.when(found["language"].isNotNull(), F.concat(F.lit("("), label(found["language"], catalog.languages), F.lit(")"))))
    return F.when(found["set_name"].isNotNull() & found["product_type"].isNotNull(), full).otherwise(F.coalesce(F.nullif(F.trim(fallback), F.lit("")), F.lit("unnamed")))


def extract(df: DataFrame, catalog: Catalog, rules: text.NameRules, name: str = "n", description: str | None = None, game_hint: str | None = None, language_hint: str | None = None, out: str = "attributes") -> DataFrame:
    """Df with a struct of all attributes and where each comes from. name is a struct of normalize_names."""
    null = F.lit(None).cast("string")
    hint = lambda c: F.col(c) if c else null
    n = F.col(name)
    if description:
        df = text.normalize_names(df, description, rules, "_dn")
    said = F.col("_dn.basic") if description else F.lit("")
    staged = df.withColumn("_g", detect_game(n["tokens"], hint(game_hint), catalog)).withColumn("_t", detect_type(n["tokens"], catalog))
    staged = staged.withColumn("_s", detect_set(n["basic"], F.col("_g"), catalog)).withColumn("_q", detect_quantity(n["basic"], said, F.col("_t"), catalog))
    staged = staged.withColumn("_l", F.coalesce(text.detect_language(n["punctuated"], n["basic"], rules), hint(language_hint)))
    game = F.coalesce("_g", "_s.game")
    names = {code: label_ for code, label_ in catalog.games.values()}
    in_name = F.exists(n["tokens"], lambda t: t.isin(*catalog.games))
    sources = F.create_map(
        F.lit("game"), F.when(in_name, "name").when(F.col("_g").isNotNull(), "store_default").when(F.col("_s").isNotNull(), "set_catalog").otherwise("unknown"),
        F.lit("set_code"), F.when(F.col("_s").isNotNull(), "name").otherwise("unknown"), F.lit("product_type"), F.when(F.col("_t").isNotNull(), "name").otherwise("unknown"), F.lit("quantity"), F.col("_q.source"),
    )
    found = F.struct(
        game.alias("game"), _table(names)[game].alias("game_name"), F.col("_s.code").alias("set_code"), F.col("_s.name").alias("set_name"), F.col("_t").alias("product_type"), F.col("_q.multiplier").alias("multiplier"),
        F.col("_q.units_total").alias("units_total"), F.col("_q.confidence").alias("quantity_confidence"), _table({t.code: t.unit_name or "" for t in catalog.types})[F.col("_t")].alias("unit_name"), F.col("_l").alias("language"), sources.alias("sources"),
    )
    return staged.withColumn(out, found).drop("_g", "_t", "_s", "_q", "_l", "_dn")


def prepare_records(raw: DataFrame, catalog: Catalog, rules: text.NameRules, store: str = "store_code") -> DataFrame:
    """Raw offers to full records: normalised name, attributes, comparable tokens, codes, stable key, digest."""
    clean = raw.withColumn("name", F.trim(parse.unescape("name")))
    named = extract(text.normalize_names(clean, "name", rules, "n"), catalog, rules, description="description")
    a = F.col("attributes")
    return named.withColumns({
        "tokens": refine_tokens(F.col("n.core_tokens"), a["game"], a["set_code"], a["language"], a["product_type"], catalog),
        "stable_key": parse.stable_key(store, "external_id", "url"), "gtins": F.array_distinct(F.filter(F.array(*(parse.gtin(c) for c in ("gtin", "ean", "upc"))), lambda c: c.isNotNull())), "mpn_key": parse.mpn("mpn"),
    }).withColumn("name_key", text.sorted_key("tokens")).withColumn("content_hash", content_hash("name", "price", "stock_status"))
