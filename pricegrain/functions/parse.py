"""Published texts to typed values: prices, stock, addresses, codes."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Text = Column | str

# Words by which shops announce each state, in the order in which they are tried.
STOCK_WORDS = [
    ("preorder", ["preventa", "pre-venta", "preorder", "pre-order", "pre order", "reserva"]),
    ("coming_soon", ["proximamente", "próximamente", "coming soon", "disponible pronto"]),
    ("out_of_stock", ["agotado", "sin stock", "no disponible", "out of stock", "sold out", "outofstock", "unavailable", "descontinuado"]),
    ("in_stock", ["en stock", "disponible", "in stock", "instock", "add to cart", "agregar al carro", "añadir al carrito", "comprar", "hay stock"]),
]


def _col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_price(raw: Text) -> Column:
    """The first number of a text. With dots and commas the one further right is the decimal mark; a lone comma is one
    before one or two digits; dots mark thousands when there are several, or three digits follow the only one."""
    found = F.regexp_replace(F.regexp_extract(_col(raw), r"([-+]?[0-9][0-9.,\s]*)", 1), r"[\s ]", "")
    dot, comma = found.contains("."), found.contains(",")
    no_dots, no_commas = F.replace(found, F.lit("."), F.lit("")), F.replace(found, F.lit(","), F.lit(""))
    comma_last = F.length(F.substring_index(found, ",", -1)) < F.length(F.substring_index(found, ".", -1))
    after_comma, after_dot = F.length(F.substring_index(found, ",", -1)), F.length(F.substring_index(found, ".", -1))
    several_dots = F.length(found) - F.length(no_dots) > 1
    plain = (
        F.when(dot & comma & comma_last, F.replace(no_dots, F.lit(","), F.lit(".")))
        .when(dot & comma, no_commas)
        .when(comma, F.when(after_comma.isin(1, 2), F.replace(found, F.lit(","), F.lit("."))).otherwise(no_commas))
        .when(dot & ((after_dot == 3) | several_dots), no_dots)
        .otherwise(found)
    )
    return plain.try_cast("double")


def parse_stock(raw: Text, fallback: str = "unknown") -> Column:
    """The first state one of whose words the text holds."""
    text = F.lower(F.trim(_col(raw)))
    out = F.lit(fallback)
    for state, names in reversed(STOCK_WORDS):
        hit = F.lit(False)
        for n in names:
            hit = hit | text.contains(n)
        out = F.when(hit, F.lit(state)).otherwise(out)
    return F.when(text.isNull() | (text == ""), F.lit(fallback)).otherwise(out)


#: What shops declare of stock, by letters alone; a page that declares several means the first of these.
AVAILABILITY = (
    ("preorder", ("preorder", "presale", "preventa", "backorder")),
    ("out_of_stock", ("outofstock", "soldout", "discontinued")),
    ("in_stock", ("instock", "limitedavailability", "onlineonly", "instoreonly")),
)


def availability(raw: Text) -> Column:
    """Declared availability, in any spelling and as an address too."""
    letters = F.regexp_replace(F.lower(_col(raw)), "[^a-z]", "")
    out = F.lit("unknown")
    for state, words in reversed(AVAILABILITY):
        out = F.when(letters.rlike("|".join(words)), F.lit(state)).otherwise(out)
    return out


def clean_url(url: Text) -> Column:
    """Without query and fragment; no slash at the end but that of the root."""
    bare = F.regexp_replace(_col(url), r"[?#].*$", "")
    root = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    path = F.regexp_replace(F.substring(bare, F.length(root) + 1, F.length(bare)), r"/+$", "")
    return F.concat(root, F.when(path == "", F.lit("/")).otherwise(path))


def variant_url(url: Text) -> Column:
    """As clean_url, but a variant parameter stays."""
    variant = F.regexp_extract(_col(url), r"[?&]variant=([^&#]*)", 1)
    return F.concat(clean_url(url), F.when(variant != "", F.concat(F.lit("?variant="), variant)).otherwise(F.lit("")))


def first_of_page(rows: DataFrame, url: str, order: str) -> DataFrame:
    """Of the rows whose addresses mean one page (variant_url) the first by order, with that address; rows without one go."""
    named = rows.withColumn(url, variant_url(url)).filter(F.col(url).isNotNull())
    others = [c for c in rows.columns if c != url]
    return named.groupBy(url).agg(F.min_by(F.struct(*others), order).alias("_v")).select(url, "_v.*")


def url_base(url: Text) -> Column:
    """The page of an offer whose address ends in #sku."""
    return F.substring_index(_col(url), "#", 1)


#: Schemes whose addresses have paths that others can be relative to.
RELATIVE_SCHEMES = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss"]
#: Scheme, host, path, query and fragment of an address (RFC 3986, appendix B).
_ADDRESS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _address(url: Column) -> Column:
    bare = F.regexp_replace(url, r"(?U)^[\s\x00-\x1F]+|[\s\x00-\x1F]+$|[\t\r\n]", "")
    part = lambda u, n: F.regexp_extract(u, _ADDRESS, n)
    return _once(bare, lambda u: F.struct(u.alias("whole"), F.lower(part(u, 1)).alias("scheme"), part(u, 2).alias("host"), part(u, 3).alias("path"), part(u, 4).alias("query"), part(u, 5).alias("fragment")))


def _without_dots(segments: Column) -> Column:
    """The path of segments, in which .. takes away the one before."""
    step = lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    path = _once(segments, lambda s: F.concat(F.aggregate(s, F.array().cast("array<string>"), step), F.when(F.element_at(s, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))))
    return F.coalesce(F.nullif(F.array_join(path, "/"), F.lit("")), F.lit("/"))


def _merged(base: Column, path: Column) -> Column:
    """A path as base's path means it; empty segments in the middle go."""
    folder = _once(F.split(base, "/", -1), lambda s: F.when(F.element_at(s, -1) != "", F.slice(s, 1, F.size(s) - 1)).otherwise(s))
    joined = _once(
        F.concat(folder, F.split(path, "/", -1)),
        lambda s: F.when(F.size(s) > 2, F.concat(F.slice(s, 1, 1), F.filter(F.slice(s, 2, F.greatest(F.size(s) - 2, F.lit(0))), lambda x: x != ""), F.slice(s, -1, 1))).otherwise(s),
    )
    return _without_dots(F.when(path.startswith("/"), F.split(path, "/", -1)).otherwise(joined))


def _resolved(a: Column) -> Column:
    b, h = a["base"], a["href"]
    scheme = F.when(h["scheme"] != "", h["scheme"]).otherwise(b["scheme"])
    path = F.when(h["host"] != "", h["path"]).when(h["path"] == "", b["path"]).otherwise(_merged(b["path"], h["path"]))
    query = F.when((h["host"] == "") & (h["path"] == "") & (h["query"] == ""), b["query"]).otherwise(h["query"])
    host = F.when(h["host"] != "", h["host"]).otherwise(b["host"])
    mark = lambda before, text, after="": F.when(text != "", F.concat(F.lit(before), text, F.lit(after))).otherwise("")
    slash = F.when((host != "") & (path != "") & ~path.startswith("/"), "/").otherwise("")
    whole = F.concat(mark("", scheme, ":"), mark("//", host), slash, path, mark("?", query), mark("#", h["fragment"]))
    return (
        F.when((h["whole"] == "") | h["whole"].rlike("^(javascript:|mailto:|#)"), F.lit(None))
        .when((b["whole"] == "") | (scheme != b["scheme"]) | ~scheme.isin(RELATIVE_SCHEMES), h["whole"])
        .otherwise(whole)
    )


def absolute_url(base: Text, href: Text) -> Column:
    """An address as a page at base means it (RFC 3986, but empty segments of merged paths go); none for scripts, mail,
    anchors, empty and null ones. White space and controls around an address go, line ends and tabs within too. Without
    base, or with one of a scheme that has no paths, the address itself."""
    empty = lambda x: F.coalesce(_col(x), F.lit(""))
    return _once(F.struct(_address(empty(base)).alias("base"), _address(empty(href)).alias("href")), _resolved)


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references, named ones too."""
    return text.map(lambda t: None if t is None else html.unescape(t))


def strip_html(text: Text) -> Column:
    """Tags to blanks, blanks collapsed; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(_col(text), r"<[^>]+>", " "), r"\s+", " ")), F.lit(""))


def dig(json: Text, path: str) -> Column:
    """The value at a dotted path; numbers are positions in lists; null where there is none."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.get_json_object(_col(json), "$" + steps)


def gtin(raw: Text) -> Column:
    """14 digits of a code with 8, 12, 13 or 14, unless all are 0."""
    digits = F.regexp_replace(_col(raw), "[^0-9]", "")
    return F.when(F.length(digits).isin(8, 12, 13, 14) & ~digits.rlike("^0*$"), F.lpad(digits, 14, "0"))


def mpn(raw: Text) -> Column:
    """Letters and digits in upper case."""
    return F.nullif(F.upper(F.regexp_replace(_col(raw), "[^A-Za-z0-9]", "")), F.lit(""))


def stable_key(store: Text, external_id: Text, url: Text) -> Column:
    """The key of human decisions; an empty id gives way to the address."""
    return F.concat(_col(store), F.lit("::"), F.coalesce(F.nullif(F.trim(_col(external_id)), F.lit("")), F.trim(_col(url))))


def clean_code(raw: Text) -> Column:
    """Digits where there are as many as a GTIN has, else the trimmed text."""
    digits = F.regexp_replace(_col(raw), "[^0-9]", "")
    return F.when(F.length(digits).isin(8, 12, 13, 14), digits).otherwise(F.nullif(F.trim(_col(raw)), F.lit("")))


def number(raw: Text) -> Column:
    """Tolerant cast."""
    return F.trim(_col(raw)).try_cast("double")


#: The declarations of a page's own price, in the order in which they are believed. Prices in scripts are left
#: out, as they may be those of related goods.
META_PRICES = (
    r'property="tiendanube:price"\s+content="([^"]+)"',
    r'property="(?:og:)?price:amount"\s+content="([^"]+)"',
    r'content="([^"]+)"\s+property="(?:og:)?price:amount"',
    r'itemprop="price"[^>]*content="([^"]+)"',
)


def meta_price(page: Text) -> Column:
    """The first of the usual price declarations of a page that is a number."""
    return F.coalesce(*(parse_price(F.nullif(F.regexp_extract(_col(page), p, 1), F.lit(""))) for p in META_PRICES))
