from __future__ import annotations

from pyspark.sql import functions as F

from pricegrain.functions import text
from pricegrain.operators import extract
from pricegrain.schema import RAW_OFFER

CATALOG = extract.Catalog(
    games={"acme": ("ac", "Acme")}, sets=[(r"\bstar\b", "ac", "series", "Star", True), (r"\bstar dust\b", "ac", "sd", "Star Dust", False)],
    types=[extract.ProductType("pack", "Pack", "one_pack", 40, 1, 0.9, "pack"), extract.ProductType("bundle", "Bundle", "pack_bundle", 70, 6, 0.95, "pack"), extract.ProductType("display", "Display", "big_display", 60, 36, 0.95, "pack")],
    quantities=[(r"^lot of (\d+) ", "multiplier", 0.9), (r"\b(\d+) pieces\b", "contents", 0.85), (r"\btimes (\d+)\b", "multiplier", 0.85)], blacklist=[88], series_tokens=["star"], language_tokens=["english"], languages={"en": "English"},
)
RULES = text.NameRules(phrases={"bundle": "pack_bundle", "single pack": "one_pack", "display": "big_display"}, stopwords=["the"], languages=[("strict", "en", r"\benglish\b")])


def found(spark, name, description=None):
    df = spark.createDataFrame([(name, description)], "name string, description string")
    df = extract.extract(text.normalize_names(df, "name", RULES), CATALOG, RULES, description="description")
    a = F.col("attributes")
    tokens = extract.refine_tokens(F.col("n.core_tokens"), a["game"], a["set_code"], a["language"], a["product_type"], CATALOG)
    return df.select("attributes.*", tokens.alias("tokens"), extract.canonical_name(a, F.col("name"), CATALOG).alias("canonical")).first()


def test_attributes(spark):
    r = found(spark, "Acme Star Dust Bundle times 6 English")
    assert (r.game, r.set_code, r.product_type, r.multiplier, r.units_total, r.quantity_confidence, r.language) == ("ac", "sd", "bundle", 1, 6, 0.95, "en")
    assert r.canonical == "Acme Star Dust Bundle (English)" and r.tokens == ["dust", "pack_bundle", "times", "6"]
    r = found(spark, "lot of 2 Star Bundle 2 pieces")  # a lot, whatever the end says
    assert (r.multiplier, r.units_total, r.quantity_confidence, r.game, r.sources["game"]) == (2, 12, 0.9, "ac", "set_catalog")
    r = found(spark, "88 pieces times 3 single pack")  # the number of an edition passes to the next pattern
    assert (r.multiplier, r.units_total) == (3, 3)
    r = found(spark, "Display single pack")
    assert r.product_type == "display" and r.tokens == ["big_display"]
    r = found(spark, "single pack times 2 thing", "holds 8 pieces")
    assert (r.multiplier, r.units_total, r.quantity_confidence, r.sources["quantity"]) == (2, 2, 0.85, "name")
    r = found(spark, "thing", "holds 8 pieces")
    assert (r.units_total, r.sources["quantity"], r.canonical, r.product_type) == (8, "description", "thing", None)
    r = found(spark, None)
    assert (r.multiplier, r.units_total, r.quantity_confidence, r.canonical) == (1, None, 0.0, "unnamed")


def test_records(spark):
    row = ["http://s/p", "Acme &amp; Bundle", 5.0, None, "CLP", " ", None, None, None, "in_stock", None, None, "a-1", "012345678905", "0012345678905", None, None, {}]
    df = spark.createDataFrame([row], RAW_OFFER).withColumn("store_code", F.lit("s"))
    r = extract.prepare_records(df, CATALOG, RULES).first()
    assert r.name == "Acme & Bundle" and r.gtins == ["00012345678905"] and r.mpn_key == "A1" and r.stable_key == "s::http://s/p" and r.tokens == ["pack_bundle"]
