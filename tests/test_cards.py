"""Listing cards, fields from several sources, links from page to page."""

from __future__ import annotations

from pricegrain.sources import html

PAGE = """<html><body><div class="price">1</div><div class="card x"><h2>First</h2><a href="/a/?x=1">go</a><span class="price" content="12.990"></span>
<div class="card"><h2>Inner</h2><a href="/b">b</a><span class="price">no</span><script type="application/ld+json">{"@type": ["Product"], "name": "LD", "sku": "S1", "offers": [{"price": 5, "availability": "OutOfStock"}]}</script></div></div>
<div class="card"><a href="/a">again</a><h2>Later</h2></div><div class="card"><h2>No link</h2></div><div class="card"><a href="#top">x</a><h2>Anchor</h2></div>
<div class="card"><a href="/c"></a><script type="application/ld+json">broken</script></div></body></html>"""


def test_cards_have_their_own_fields(spark):
    pages = spark.createDataFrame([(1, "http://s.test/l?page=2", PAGE, "x"), (2, "http://s.test/m", None, "y"), (3, "http://s.test/n", "", "z")], "id long, url string, html string, position string")
    got = {r.url: r for r in html.card_offers(pages, "html", "url", ".card", {"name": "h2", "price": ".price", "stock": ".stock"}).collect()}
    assert set(got) == {"http://s.test/a", "http://s.test/b"}  # without a name or a link there is no offer
    a, b = got["http://s.test/a"], got["http://s.test/b"]
    assert (a.id, a.name, a.price, a.price_raw, a.position, a.page_url) == (1, "First", 12990.0, "12.990", 0, "http://s.test/l?page=2")
    assert (b.name, b.price, b.price_raw, b.stock_status, b.external_id, b.sku) == ("Inner", 5.0, "no", "out_of_stock", "S1", "S1")
    # the outer card has the inner one's JSON-LD too, but its own name and price come first
    assert a.stock_status == "out_of_stock"


def test_links_are_followed_to_the_end(spark):
    rows = [("a", "b", 3), ("b", "c", 1), ("c", "d", 2), ("d", "b", 1), ("e", "f", 1), ("f", "g", 0), ("g", "a", 5), ("h", "nowhere", 1), ("i", None, 1), ("z", "a", 0)]
    links = spark.createDataFrame(rows, "url string, next_url string, items long")
    starts = spark.createDataFrame([(x, x) for x in "aehiz"] + [("q", "missing")], "start string, url string")
    got = lambda most: sorted((r.start, r.position, r.url) for r in html.follow(starts, links, most).collect())
    assert got(50) == [("a", 0, "a"), ("a", 1, "b"), ("a", 2, "c"), ("a", 3, "d"), ("e", 0, "e"), ("h", 0, "h"), ("i", 0, "i")]
    assert got(3) == [x for x in got(50) if x[1] < 3] and got(1) == [x for x in got(50) if x[1] < 1]
    long = spark.createDataFrame([(f"p{i}", f"p{i + 1}", 1) for i in range(100)], "url string, next_url string, items long")
    found = html.follow(spark.createDataFrame([("s", "p0"), ("t", "p90")], "start string, url string"), long, 50).collect()
    assert sorted(r.position for r in found if r.start == "s") == list(range(50)) and sorted(r.position for r in found if r.start == "t") == list(range(10))
    pages = spark.createDataFrame([("http://s.test/a/1", '<link rel="next" href="2">'), ("http://s.test/b", '<a href="/x">'), ("http://s.test/c", None)], "url string, html string")
    assert {r.url: r.next_url for r in html.next_links(pages, "html", "url").collect()} == {"http://s.test/a/1": "http://s.test/a/2", "http://s.test/b": None, "http://s.test/c": None}


def test_pages_of_one_address_keep_their_own_cards(spark):
    pages = spark.createDataFrame([(i, "http://s.test/c", f'<p class="card"><a href="/a">{n}</a></p>') for i, n in ((1, "x"), (2, "y"))], "page_id long, url string, html string")
    found = html.card_offers(pages, "html", "url", ".card", {"name": "a"})
    assert {(r.page_id, r.url, r.name) for r in found.collect()} == {(1, "http://s.test/a", "x"), (2, "http://s.test/a", "y")}
