"""Product pages: selectors, JSON-LD, links. Parsing needs Python; it runs batch by batch where the pages lie."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricegrain.functions import parse
from pricegrain.operators.storage import discard, written

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = T.ArrayType(T.StringType())


def _steps(selector: str) -> list[list[str]]:
    return [re.findall(r"^[a-z][a-z0-9-]*|\.[\w-]+|#[\w-]+|\[[^\]]+\]", part, re.I) for part in selector.split()]


class _Picker(HTMLParser):
    """Texts and attributes of the elements that a simple selector names: tag, .class, #id, [attr] or [attr=value], together
    or below one another by spaces."""

    def __init__(self, selectors: Sequence[str]):
        super().__init__(convert_charrefs=True)
        self.steps = [_steps(s) for s in selectors]
        self.open: list[tuple[str, dict]] = []
        self.found: list[list[dict]] = [[] for _ in selectors]
        self.texts: list[tuple[int, dict]] = []

    @staticmethod
    def _fits(step: list[str], tag: str, attrs: dict) -> bool:
        for s in step:
            if s[0] == ".":
                ok = s[1:] in (attrs.get("class") or "").split()
            elif s[0] == "#":
                ok = attrs.get("id") == s[1:]
            elif s[0] == "[":
                name, _, value = s[1:-1].partition("=")
                ok = name in attrs and (not value or attrs[name] == value.strip("'\""))
            else:
                ok = s.lower() == tag
            if not ok:
                return False
        return bool(step)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = dict(attrs)
        for i, steps in enumerate(self.steps):
            if self._fits(steps[-1], tag, own):
                above = iter(self.open)
                if all(any(self._fits(step, t, a) for t, a in above) for step in steps[:-1]):
                    hit = {"attrs": own, "text": []}
                    self.found[i].append(hit)
                    if tag not in VOID:
                        self.texts.append((len(self.open), hit))
        if tag not in VOID:
            self.open.append((tag, own))

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                self.texts = [(d, h) for d, h in self.texts if d < depth]
                return

    def handle_data(self, data: str) -> None:
        for _, hit in self.texts:
            hit["text"].append(data)


class _Cards(_Picker):
    """The hits of the selectors within each element that the card's selector names; of nested cards each has its own."""

    def __init__(self, card: str, selectors: Sequence[str]):
        super().__init__(selectors)
        self.card = _steps(card)
        self.cards: list[list[list[dict]]] = []
        self.within: list[tuple[int, list[list[dict]]]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        depth, before = len(self.open), [len(hits) for hits in self.found]
        super().handle_starttag(tag, attrs)
        for i, hits in enumerate(self.found):
            for _, own in self.within:
                own[i] += hits[before[i] :]
        above = iter(self.open[:depth])
        if tag not in VOID and self._fits(self.card[-1], tag, dict(attrs)) and all(any(self._fits(step, t, a) for t, a in above) for step in self.card[:-1]):
            self.cards.append([[] for _ in self.steps])
            self.within.append((depth, self.cards[-1]))

    def handle_endtag(self, tag: str) -> None:
        super().handle_endtag(tag)
        self.within = [(d, own) for d, own in self.within if d < len(self.open)]


#: Attributes that hold a value where an element has no text.
VALUES = ("content", "value", "data-value")


def _value(hits: list[dict], attr: str) -> str | None:
    """The first value of a selector's hits: the named attribute, or else the text, or else one of VALUES."""
    for hit in hits:
        found = [hit["attrs"].get(attr)] if attr else [" ".join("".join(hit["text"]).split()), *map(hit["attrs"].get, VALUES)]
        for value in found:
            if value:
                return value
    return None


def select_cards(pages: DataFrame, html: str, card: str, selectors: Mapping[str, str]) -> DataFrame:
    """A row for each element that the card's selector names (position, in the page's order), with a string column for each
    selector, looked up inside the card alone, and ld: the text of the card's JSON-LD scripts. Selectors may have
    alternatives (commas) and '@attr'. Columns of pages named alike are replaced. Pages without cards, null ones too, give
    no rows."""
    own = ["position", *selectors, "ld"]
    kept = [c for c in pages.columns if c not in own and c != html]
    wanted = [(name, part.strip().partition("@")) for name, s in [*selectors.items(), ("ld", "script[type=application/ld+json]")] for part in s.split(",")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, page in enumerate(pdf["_html"]):
                parser = _Cards(card, [sel for _, (sel, _, _) in wanted])
                parser.feed(page or "")
                rows = []
                for position, hits in enumerate(parser.cards):
                    row: dict = dict.fromkeys(own) | {"position": position}
                    for (name, (_, _, attr)), found in zip(wanted, hits):
                        row[name] = row[name] or _value(found, attr)
                    rows.append(row)
                if rows:
                    beside = pdf.drop(columns="_html").iloc[[i] * len(rows)].reset_index(drop=True)
                    yield pd.concat([beside, pd.DataFrame(rows, columns=own, dtype=object)], axis=1)

    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField("position", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in own[1:])])
    return pages.select(*kept, F.col(html).alias("_html")).mapInPandas(read, schema)


def _ld_fields(block: Column) -> dict[str, Column]:
    """An offer's fields from a Product block of JSON-LD."""
    get = lambda f: F.get_json_object(block, f"$.{f}")
    first = lambda f, inner: F.when(get(f).startswith("["), F.coalesce(get(f"{f}[0].{inner}"), get(f"{f}[0]"))).when(get(f).startswith("{"), get(f"{f}.{inner}")).otherwise(get(f))
    offer = lambda f: F.coalesce(get(f"offers.{f}"), get(f"offers[0].{f}"))
    return {
        "name": get("name"), "price": F.coalesce(offer("price"), offer("lowPrice")), "stock": offer("availability"), "image": first("image", "url"), "description": parse.strip_html(get("description")),
        "brand": first("brand", "name"), **{f: get(f) for f in ("sku", "mpn", "upc", "ean", "gtin")},
    }


def filled_offers(found: DataFrame, ld: str = "ld", url: str | None = None) -> DataFrame:
    """Offers field by field: what a selector found (the columns name, price, stock, image, description, brand, sku, mpn, upc, ean,
    gtin, as far as they are there), or else what the first Product of the JSON-LD in ld says. A price is a number: of a
    selector's text that is none the JSON-LD's is taken; the same for a stock that is not known. Rows without a name go.
    Adds price_raw and stock_status; sku is the external_id where there is none."""
    block = F.filter(json_ld(F.filter(F.array(ld), lambda t: t.isNotNull())), lambda b: F.lower(F.get_json_object(b, "$['@type']")).rlike(r'^product$|"product"'))
    rows = found.withColumn("_block", F.get(block, F.lit(0)))
    said = _ld_fields(F.col("_block"))
    own = lambda f: F.nullif(F.trim(F.col(f)), F.lit("")) if f in found.columns else F.lit(None).cast("string")
    both = {f: F.coalesce(own(f), v) for f, v in said.items() if f not in ("price", "stock")}
    stock = parse.parse_stock(own("stock"))
    both |= {
        "price": F.coalesce(parse.parse_price(own("price")), parse.parse_price(said["price"])), "price_raw": own("price"),
        "stock_status": F.when(stock != "unknown", stock).otherwise(parse.availability(said["stock"])),
    }
    if "external_id" not in found.columns:
        both["external_id"] = both["sku"]
    out = rows.withColumns(both).drop("_block", ld, "stock").filter("name IS NOT NULL")
    return out.withColumn("image", parse.absolute_url(url, "image")) if url else out


def card_offers(pages: DataFrame, html: str, url: str, card: str, selectors: Mapping[str, str], link: str = "a@href") -> DataFrame:
    """An offer for each listing card of a page that links to something: its address absolute and cleaned, its other
    fields from the selectors or the card's own JSON-LD. Of several cards that link to one address the first counts."""
    cards = select_cards(pages.withColumnRenamed(url, "_page"), html, card, {**selectors, "_href": link})
    page = ["_page", *(c for c in pages.columns if c not in (html, url) and c in cards.columns and c not in ("position", "ld", *selectors))]  # several pages may have one address
    placed = cards.withColumn("url", parse.clean_url(parse.absolute_url("_page", "_href"))).filter("url IS NOT NULL")
    first = placed.withColumn("_nth", F.row_number().over(W.partitionBy(*page, "url").orderBy("position"))).filter("_nth = 1").drop("_nth", "_href")
    return filled_offers(first, url="_page").withColumnRenamed("_page", "page_url")


def next_links(pages: DataFrame, html: str, url: str, selector: str = "a[rel=next], link[rel=next]") -> DataFrame:
    """(url, next_url): the address of the page that a page says comes next, absolute; null if it says none."""
    found = select_fields(pages.select(F.col(url).alias("url"), F.col(html).alias("_page")), "_page", {"href": ", ".join(f"{s.strip()}@href" for s in selector.split(","))})
    return found.select("url", parse.absolute_url("url", "href").alias("next_url"))


def follow(starts: DataFrame, links: DataFrame, most: int = 50) -> DataFrame:
    """(start, position, url): the pages that come after each start, most at most, by jumps of doubled length: a page's jump of
    2k is the jump of k from where its jump of k leads. About log2(most) joins, whatever the number of starts.

    starts (start, url), links (url, next_url, items): items is the number of goods on a page. A series ends before a page
    without goods or one that was not stored, and where it comes back to a page that it had.
    """
    pages = links.groupBy("url").agg(F.max_by("next_url", F.coalesce("items", F.lit(0))).alias("next_url"), F.max(F.coalesce("items", F.lit(0))).alias("items")).filter("items > 0").select("url", "next_url")
    jumps = written(pages.join(pages.select(F.col("url").alias("next_url")), "next_url", "left_semi").select("url", F.col("next_url").alias("to")), "jumps")
    reached = written(starts.select("start", "url").distinct().join(pages.select("url"), "url", "left_semi").select("start", F.lit(0).alias("position"), "url"), "reached")
    step = 1
    while step < most:
        further = reached.join(jumps, "url").select("start", (F.col("position") + step).alias("position"), F.col("to").alias("url"))
        both = written(reached.unionByName(further).filter(F.col("position") < most), "reached")
        longer = jumps.join(jumps.select(F.col("url").alias("to"), F.col("to").alias("beyond")), "to").select("url", F.col("beyond").alias("to"))
        after = written(longer, "jumps")
        discard(reached, jumps)
        reached, jumps, step = both, after, step * 2
    # in a loop a page comes again and again: its first place counts
    return reached.groupBy("start", "url").agg(F.min("position").alias("position")).select("start", "position", "url")


#: Stands for & in pages whose character references are to stay; the first of these that the page does not hold.
_MARKS = [chr(c) for c in range(0xE000, 0xF900)]


def pick(page: str | None, selectors: Mapping[str, str], decoded: bool = True) -> dict[str, str | None]:
    """For each name the first hit of its selectors (alternatives by commas): its text, or with '@attr' behind, that attribute.
    Not decoded: as it is written, with its character references and white space."""
    wanted = [(name, part.strip().partition("@")) for name, s in selectors.items() for part in s.split(",")]
    picker = _Picker([sel for _, (sel, _, _) in wanted])
    page = page or ""
    mark = "&" if decoded else next(m for m in _MARKS if m not in page)
    picker.feed(page.replace("&", mark))
    out: dict[str, str | None] = dict.fromkeys(selectors)
    for (name, (_, _, attr)), hits in zip(wanted, picker.found):
        for hit in hits:
            text = "".join(hit["text"])
            value = hit["attrs"].get(attr) if attr else " ".join(text.split()) if decoded else text
            if value and out[name] is None:
                out[name] = value.replace(mark, "&")
    return out


def select_fields(pages: DataFrame, html: str, selectors: Mapping[str, str], decoded: bool = True) -> DataFrame:
    """Pages with a string column for each selector, not decoded: as written (see pick). Columns named alike are replaced."""
    kept = [c for c in pages.columns if c not in selectors]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pd.DataFrame([pick(p, selectors, decoded) for p in pdf["_html"]], columns=list(selectors), index=pdf.index, dtype=object)
            yield pd.concat([pdf.drop(columns="_html"), found], axis=1)

    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField(c, T.StringType()) for c in selectors])
    return pages.select(*kept, F.col(html).alias("_html")).mapInPandas(read, schema)


def select_all(pages: DataFrame, html: str, selector: str, attr: str | None = None) -> DataFrame:
    """A row for each hit of a selector, in the page's order."""
    name = f"{selector}@{attr}" if attr else selector

    @F.pandas_udf(BLOCKS)
    def every(page: pd.Series) -> pd.Series:
        return page.map(lambda p: hits_of(p, selector, attr))

    return pages.select(*[c for c in pages.columns if c != html], F.posexplode(every(F.col(html))).alias("position", "value")).withColumn("selector", F.lit(name)).drop("selector")


def scripts_of(page: str | None) -> list[str]:
    """The texts of a page's JSON-LD scripts."""
    return re.findall(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", page or "")


def hits_of(page: str | None, selector: str, attribute: str | None = None) -> list[str]:
    """What select_all finds in one page."""
    picker = _Picker([selector])
    picker.feed(page or "")
    return [v for h in picker.found[0] if (v := h["attrs"].get(attribute) if attribute else " ".join("".join(h["text"]).split()))]


def _flat(data: object) -> Iterator[dict]:
    todo = [data]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo += reversed(node)
        elif isinstance(node, dict):
            yield node
            todo += [node[k] for k in ("mainEntity", "itemListElement", "@graph") if k in node]


@F.pandas_udf(BLOCKS)
def json_ld(scripts: pd.Series) -> pd.Series:
    """The objects of a page's JSON-LD scripts, nested lists and graphs laid flat, as JSON; broken scripts give none."""

    def one(texts: Sequence[str] | None) -> list[str]:
        out = []
        for t in [] if texts is None else texts:
            try:
                out += [json.dumps(b) for b in _flat(json.loads(t))]
            except ValueError:
                continue
        return out

    return scripts.map(one)


def json_ld_blocks(pages: DataFrame, html: str) -> DataFrame:
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), 1)
    return pages.withColumn("blocks", json_ld(scripts))


def ld_products(pages: DataFrame, html: str, url: str = "url") -> DataFrame:
    """An offer for each Product block of a page that names it; several make addresses url#sku."""
    get = lambda f: F.get_json_object("block", f"$.{f}")
    blocks = json_ld_blocks(pages, html).select(*[c for c in pages.columns if c != html], F.posexplode("blocks").alias("position", "block"))
    product = blocks.filter(F.lower(get("@type")).rlike(r'^product$|"product"'))
    offer = lambda f: F.coalesce(get(f"offers.{f}"), get(f"offers[0].{f}"))
    first = lambda f, inner: F.when(get(f).startswith("["), F.coalesce(get(f"{f}[0].{inner}"), get(f"{f}[0]"))).when(get(f).startswith("{"), get(f"{f}.{inner}")).otherwise(get(f))
    own = product.filter(get("url").isNull() | (parse.clean_url(get("url")) == parse.clean_url(url)))
    counted = own.join(own.groupBy(url).agg(F.count("*").alias("_n")), url)
    sku = get("sku")
    return counted.select(
        *[c for c in pages.columns if c not in (html, url)], F.when((F.col("_n") > 1) & sku.isNotNull(), F.concat_ws("#", url, sku)).otherwise(F.col(url)).alias(url), "position", get("name").alias("name"),
        parse.strip_html(get("description")).alias("description"), first("image", "url").alias("image_url"), first("brand", "name").alias("brand"), sku.alias("sku"), get("mpn").alias("mpn"),
        F.coalesce(get("gtin"), get("gtin14"), get("gtin13"), get("gtin12"), get("gtin8")).alias("gtin"), parse.parse_price(F.coalesce(offer("price"), offer("lowPrice"))).alias("price"), offer("priceCurrency").alias("currency"),
        parse.availability(offer("availability")).alias("stock_status"),
    )
