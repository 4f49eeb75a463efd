"""Shops' JSON payloads, stored one page a row, to raw offers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricegrain.functions import parse, text

#: Fields of a generic feed where a shop's description names no path of its own.
DEFAULT_PATHS = {c: c for c in ("name", "url", "price", "image", "description", "sku", "mpn", "upc", "ean", "gtin", "brand", "currency")} | {"stock": "available", "external_id": "id"}


def items(pages: DataFrame, payload: str = "payload", list_path: str | None = None) -> DataFrame:
    """A row for each item of each payload, with its position. The list is that at list_path, the payload itself, or its
    items or results; payloads that are not JSON or hold no list give no rows. X7: their number is bad_payloads()."""
    at = parse.dig(payload, list_path) if list_path else F.trim(payload)
    as_list = lambda c: F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>"))
    listed = F.coalesce(as_list(at), as_list(F.get_json_object(at, "$.items")), as_list(F.get_json_object(at, "$.results")))
    return pages.select(*[c for c in pages.columns if c != payload], F.posexplode(listed).alias("position", "item")).filter("item IS NOT NULL")


def bad_payloads(pages: DataFrame, payload: str = "payload") -> DataFrame:
    return pages.filter(F.col(payload).isNotNull() & F.try_parse_json(F.col(payload)).isNull())


def _image(value: Column) -> Column:
    """A text, an object with src or url, or the first of a list of either."""
    one = F.when(value.startswith("["), F.get_json_object(value, "$[0]")).otherwise(value)
    return F.when(one.startswith("{"), F.coalesce(F.get_json_object(one, "$.src"), F.get_json_object(one, "$.url"))).otherwise(one)


def generic_offers(found: DataFrame, base_url: str, paths: Mapping[str, str] = {}, url_template: str | None = None, divisor: float = 1, currency: str = "CLP") -> DataFrame:
    """The fields at their paths; items without name or address are left out."""
    own = DEFAULT_PATHS | dict(paths)
    at = lambda f: parse.dig("item", own[f])
    raw = at("url")
    href = F.replace(F.lit(url_template), F.lit("{value}"), raw) if url_template else raw
    stock = at("stock")
    picked = found.withColumns({
        "name": at("name"), "_href": href, "price_raw": at("price"), "stock_raw": stock, "external_id": at("external_id"), "image_url": _image(at("image")), "description": parse.strip_html(at("description")),
        "currency": F.coalesce(F.nullif(at("currency"), F.lit("")), F.lit(currency)), **{c: F.nullif(F.trim(at(c)), F.lit("")) for c in ("sku", "mpn", "upc", "ean", "gtin", "brand")},
    }).filter("name <> '' AND _href <> ''")
    full = picked.withColumn("url", parse.clean_url(parse.absolute_url(F.lit(base_url.rstrip("/") + "/"), F.col("_href"))))
    return full.withColumns({
        "price": parse.parse_price("price_raw") / divisor,
        "stock_status": F.when(stock == "true", "in_stock").when(stock == "false", "out_of_stock").otherwise(parse.parse_stock(stock)),
    }).drop("_href", "item", "position")


VARIANT = "struct<id:string,title:string,price:string,available:boolean,sku:string,barcode:string,featured_image:struct<src:string>>"


def variant_suffix(title: Column, variant: Column, language_words: Sequence[str]) -> Column:
    """The words that a variant adds to the title; words of languages always count."""
    plain = lambda c: F.lower(text.fold_latin(c))
    there = F.regexp_extract_all(plain(title), F.lit("([a-z0-9]+)"), 1)
    new = F.filter(F.split(F.trim(variant), r"[^\p{L}\p{N}_]+"), lambda w: (w != "") & (~F.array_contains(there, plain(w)) | plain(w).isin(*language_words)))
    return F.when(F.lower(F.trim(F.coalesce(variant, F.lit("")))).isin("", "default title"), "").otherwise(F.array_join(new, " "))


def storefront_offers(found: DataFrame, base_url: str, language_words: Sequence[str] = (), expand: bool = True, currency: str = "CLP") -> DataFrame:
    """An offer for each variant where there are several, else one: lowest price, available if any variant is."""
    base = base_url.rstrip("/")
    get = lambda f: F.get_json_object("item", f"$.{f}")
    parsed = found.withColumns({"_title": get("title"), "_handle": get("handle"), "_v": F.coalesce(F.from_json(get("variants"), f"array<{VARIANT}>"), F.array().cast(f"array<{VARIANT}>")), "_image": F.coalesce(get("images[0].src"), get("images[0]"))}).filter("_title <> '' AND _handle <> ''")
    several = (F.size("_v") > 1) & F.lit(expand)
    common = [c for c in found.columns if c not in ("item", "position")]
    barcode = lambda c: [F.when(F.length(c) == 13, c).alias("ean"), F.when(F.length(c) == 12, c).alias("upc"), c.alias("gtin")]
    tail = [get("body_html"), get("vendor")]
    v = F.col("v")
    suffix = variant_suffix(F.col("_title"), v["title"], language_words)
    each = parsed.filter(several).withColumn("v", F.explode("_v")).filter("v.id IS NOT NULL").select(
        *common, F.concat(F.lit(f"{base}/products/"), "_handle", F.lit("?variant="), v["id"]).alias("url"), F.when(suffix == "", F.col("_title")).otherwise(F.concat("_title", F.lit(" - "), suffix)).alias("name"),
        parse.parse_price(v["price"]).alias("price"), v["price"].alias("price_raw"), F.lit(currency).alias("currency"), v["id"].alias("external_id"), F.coalesce(v["featured_image"]["src"], F.col("_image")).alias("image_url"),
        parse.strip_html(tail[0]).alias("description"), F.when(v["available"], "in_stock").otherwise("out_of_stock").alias("stock_status"), v["sku"].alias("sku"), *barcode(v["barcode"]), tail[1].alias("brand"),
    )
    first = F.try_element_at("_v", F.lit(1))
    lowest = F.array_min(F.transform("_v", lambda x: parse.parse_price(x["price"])))
    one = parsed.filter(~several).select(
        *common, parse.clean_url(F.concat(F.lit(f"{base}/products/"), "_handle")).alias("url"), F.col("_title").alias("name"), lowest.alias("price"), first["price"].alias("price_raw"), F.lit(currency).alias("currency"),
        get("id").alias("external_id"), F.col("_image").alias("image_url"), parse.strip_html(tail[0]).alias("description"),
        F.when(F.size("_v") == 0, "unknown").when(F.exists("_v", lambda x: F.coalesce(x["available"], F.lit(False))), "in_stock").otherwise("out_of_stock").alias("stock_status"),
        first["sku"].alias("sku"), *barcode(first["barcode"]), tail[1].alias("brand"),
    )
    return each.unionByName(one)


def minor_unit_offers(found: DataFrame, currency: str = "CLP") -> DataFrame:
    """Prices as whole numbers of the smallest unit."""
    get = lambda f: F.get_json_object("item", f"$.{f}")
    raw = get("prices.price")
    price = F.coalesce(raw.try_cast("double") / F.pow(F.lit(10.0), F.coalesce(get("prices.currency_minor_unit").try_cast("int"), F.lit(0))), parse.parse_price(raw))
    return found.select(
        *[c for c in found.columns if c not in ("item", "position")], parse.clean_url(get("permalink")).alias("url"), get("name").alias("name"), price.alias("price"), raw.alias("price_raw"),
        F.coalesce(get("prices.currency_code"), F.lit(currency)).alias("currency"), get("id").alias("external_id"), get("images[0].src").alias("image_url"), parse.strip_html(F.coalesce(F.nullif(get("description"), F.lit("")), get("short_description"))).alias("description"),
        F.when(get("is_in_stock") == "true", "in_stock").otherwise("out_of_stock").alias("stock_status"), F.nullif(get("sku"), F.lit("")).alias("sku"),
    ).filter("name <> '' AND url IS NOT NULL")


def first_per_url(offers: DataFrame, cap: int | None = None, store: str = "store_id", order: str = "seq") -> DataFrame:
    """The first offer of each address of a shop, and at most cap of a shop."""
    first = offers.groupBy(store, "url").agg(F.min_by(F.struct(*[c for c in offers.columns if c not in (store, "url")]), order).alias("_o")).select(store, "url", "_o.*")
    if cap is None:
        return first
    return first.withColumn("_nth", F.row_number().over(W.partitionBy(store).orderBy(order, "url"))).filter(F.col("_nth") <= cap).drop("_nth")


def page_urls(categories: DataFrame, url: str = "url", param: str = "page", start: int = 1, pages: int = 50) -> DataFrame:
    """Addresses of a category's pages."""
    sep = F.when(F.col(url).contains("?"), "&").otherwise("?")
    return categories.withColumn("page", F.explode(F.sequence(F.lit(start), F.lit(start + pages - 1)))).withColumn("page_url", F.concat(F.col(url), sep, F.lit(f"{param}="), F.col("page").cast("string")))


def needs_read(fetched: DataFrame, cache: DataFrame) -> DataFrame:
    """Bodies that differ from the last ones by digest, or are new."""
    old = cache.select("url", F.col("body_hash").alias("_old"))
    return fetched.join(old, "url", "left").filter(~F.col("body_hash").eqNullSafe(F.col("_old"))).drop("_old")


def merged_sources(api: DataFrame, shop: DataFrame, page: DataFrame, key: str = "url") -> DataFrame:
    """The first source that knows a page gives name and price; a page's own stock fills in where the source has none."""
    a, b, c = (d.select(key, *(F.col(x).alias(f"{x}_{i}") for x in ("name", "price", "stock_status"))) for i, d in enumerate((api, shop, page)))
    joined = a.join(b, key, "full").join(c, key, "full")
    stock = F.coalesce(*(F.nullif(f"stock_status_{i}", F.lit("unknown")) for i in range(3)), F.lit("unknown"))
    return joined.select(key, *(F.coalesce(*(f"{x}_{i}" for i in range(3))).alias(x) for x in ("name", "price")), stock.alias("stock_status"))
