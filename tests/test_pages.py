"""Front page, watch pass and watch list, case by case."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricegrain.functions import money, parse
from pricegrain.operators import changes, market, search
from pricegrain.plans import catalogue
from pricegrain.sources import html


def test_front_deals_say_what_they_are(spark):
    drops = lambda n: spark.createDataFrame([(i, 100.0 - i) for i in range(n)], "product_id long, amount double")
    spread = spark.createDataFrame([(i, float(i)) for i in range(1, 9)], "product_id long, discount double")
    got = lambda n: [(r.product_id, r.part, r.source) for r in search.front_deals(drops(n), spread, 5).collect()]
    assert got(4) == [(i, "drop", "drops") for i in range(4)]
    assert got(2) == [(0, "drop", "mixed"), (1, "drop", "mixed"), (8, "spread", "mixed"), (7, "spread", "mixed"), (6, "spread", "mixed")]
    assert got(0) == [(i, "spread", "spread") for i in (8, 7, 6, 5, 4)]


def test_watch_pass_tells_once_and_keeps_what_was_not_read(spark):
    kind = "url string, http_status int, stock_status string, price double"
    known = spark.createDataFrame([("a", 404, "unknown", None), ("b", 200, "out_of_stock", 5.0), ("c", 200, "in_stock", 5.0), ("d", 200, "in_stock", 9.0), ("e", 200, "in_stock", 1.0)], kind)
    read = spark.createDataFrame([("a", 200, "in_stock", 7.0), ("b", 200, "in_stock", 5.0), ("c", 500, None, None), ("d", 200, "in_stock", 5.0), ("new", 200, "in_stock", 5.0)], kind)
    told = spark.createDataFrame([("b", "purchasable", 5.0), ("d", "price_down", 6.0)], "url string, event string, price double")
    events, state = changes.watch_pass(read, known, told)
    assert sorted((r.url, r.event, r.price) for r in events.collect()) == [("a", "published", 7.0), ("d", "price_down", 5.0)]
    after = {r.url: (r.http_status, r.price) for r in state.collect()}
    assert after == {"a": (200, 7.0), "b": (200, 5.0), "c": (500, None), "d": (200, 5.0), "e": (200, 1.0), "new": (200, 5.0)}
    again = changes.watch_pass(read, state, told)
    assert again[0].count() == 0


def test_small_ones(spark):
    rows = spark.createDataFrame([(2, "https://s.t/p/1/?a=1#x"), (1, "https://s.t/p/1"), (3, "https://s.t/p/1?variant=7&b=2"), (4, None)], "k long, url string")
    assert {(r.url, r.k) for r in parse.first_of_page(rows, "url", "k").collect()} == {("https://s.t/p/1", 1), ("https://s.t/p/1?variant=7", 3)}
    images = spark.createDataFrame([(1, 1, ""), (1, 3, "c"), (1, 2, None), (1, 4, "d"), (2, 5, None)], "g long, o long, image string")
    assert {r.g: r.image for r in market.first_image(images, "g", "image", "o").collect()} == {1: "c", 2: None}
    line = spark.range(1).select(money.saving_line(F.lit("A & B (x)"), F.lit("Shop"), F.lit(36990.0), F.lit(5000.4), F.lit(12.4)).alias("t")).first().t
    assert line == "★ A &amp; B · x: $36.990 in Shop (−$5.000, 12 %)"


def test_settings_files_and_sql_functions(spark, tmp_path):
    from pricegrain.functions import sql
    from pricegrain.sources import catalogue

    for name, text in {"a/one.json": '{\n "code": "a", "pages": 3, "x": 1}', "a/two.json": '{"code": "a", "pages": 4}', "b.json": '{"code": "b"}', "c.json": "[1]", "d.json": "{", "e.json": '{"code": ""}', "f.txt": '{"code": "f"}', "g.json": ""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = catalogue.read_files(spark, str(tmp_path), "code string, pages int")
    assert {r.code: r.pages for r in found.collect()} == {"a": 4, "b": None}
    rows = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "code string")
    assert {r.code: r.pages for r in catalogue.with_settings(rows, found, "code", ["pages"], {"pages": 9}).collect()} == {"a": 4, "b": 9, "z": 9, None: 9}
    names = sql.register(spark)
    assert names == sql.register(spark) and len(names) == 10
    one = lambda text: [tuple(r) for r in spark.sql(text).collect()]
    assert one("SELECT pg_unit_price(10, 4, 0.9), pg_unit_price(10, 4, 0.5), pg_saving(3, 5), pg_saving(3, 0), pg_discount_percent(5, 10), pg_discount_percent(NULL, 10)") == [(2.5, None, 2.0, None, 50.0, 0.0)]
    assert one("SELECT pg_days_until(TIMESTAMP '2024-01-03 01:00:00', TIMESTAMP '2024-01-01'), pg_jaro_winkler('martha', 'marhta') > 0.96, pg_unescape('&eacute;')") == [(3, True, "é")]
    page = """<a href="/x">one</a><script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "P"}, {"@type": ["A", "B"]}]}</script><script type="application/ld+json">{</script><a href="/y"></a>"""
    spark.createDataFrame([(1, page), (2, None)], "k int, html string").createOrReplaceTempView("some_pages")
    assert one("SELECT k, position, value FROM some_pages, LATERAL pg_page_links(html, 'a', 'href') ORDER BY position") == [(1, 0, "/x"), (1, 1, "/y")]
    assert [(t, n) for _, t, n in one("SELECT position, type, name FROM some_pages, LATERAL pg_page_blocks(html) WHERE type IS NOT NULL ORDER BY position")] == [("Product", "P"), ('["A", "B"]', None)]


def test_a_saving_a_hair_below_a_half_counts_as_the_half(spark):
    rows = spark.createDataFrame([(x,) for x in (49866.494999999995, 1.005, 2.675, -2.675, 3.0, None)], "x double")
    assert [r.y for r in rows.select(money.rounded("x", 2).alias("y")).collect()] == [49866.5, 1.0, 2.68, -2.68, 3.0, None]
    line = rows.limit(1).select(money.saving_line(F.lit("n"), F.lit("s"), F.lit(5084.0), money.rounded("x", 2), F.lit(91.0)).alias("y")).first().y
    assert "$49.867" in line


def test_page_fields_are_read_as_they_are_written(spark, tmp_path):
    titles = ["<title>a &amp;&amp;lt; b&amp &quot;c&nbsp;</title>", "<title> x\n\t y </title>", "<title> </title>", ""]
    pages = [(i, f'<html lang="a&amp;b">{t}') for i, t in enumerate(titles)] + [(7, "<html><title>t</title>"), (8, None), (9, "<html lang=''><title>\ue000&lt;</title>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.language, r.title) for r in catalogue.QUERIES["page_fields"](spark, str(tmp_path)).collect()}
    assert got == {0: ("a&amp;b", "a &&lt; b&amp &quot;c&nbsp;"), 1: ("a&amp;b", "x y"), 2: ("a&amp;b", None), 3: ("a&amp;b", None), 7: ("", "t"), 8: (None, None), 9: ("", "\ue000<")}
    assert html.pick(titles[0], {"t": "title"}) == {"t": 'a &&lt; b& "c'}
