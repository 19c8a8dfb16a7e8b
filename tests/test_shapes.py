"""Expected shapes of pages: selectors in one walk, and tables of mixed shapes."""

import time

import pytest
from pyspark.sql import functions as F

from wayside.operators import pages
from wayside.operators.selectors import SelectorList


def missing(html, **selectors):
    return SelectorList(list(selectors.items())).missing(html)


@pytest.mark.parametrize(
    ("selector", "html", "found"),
    [
        ("h2", "<H2>a</H2>", True),
        ("h2", "<!-- <h2>a</h2> --><p>h2", False),
        ("h2", "<script>'<h2>'</script><style><h2></style><title><h2></h2></title><textarea><h2></textarea>", False),
        ("h2", "<title>a</title><h2>b", True),
        ("a[href]", "<a name=x>", False),
        ("a[href]", "<a href>", True),
        ("div[class*='_date_']", '<div class="x a_date_9">', True),
        ("div[class*='_date_']", '<div data-class="_date_"><p class="_date_">', False),
        ("div[class*='_date_']", '<div class="x" class="_date_">', False),
        ("p.a.b", '<p class="b c a">', True),
        ("p.a.b", '<p class="a"><p class="b">', False),
        (".a", '<p class="ab">', False),
        (".a", "<p class=\"x\n a\">", True),
        ("section.s dl", "<section class=s><div><dl>", True),
        ("section.s dl", "<section class=s></section><dl>", False),
        ("section.s dl", "<dl><section class=s></section></dl>", False),
        ("dl.t > dd", "<dl class=t><dt>a<dd>b</dl>", True),
        ("dl.t > dd", "<dl class=t><dt>a<dl><dd>b</dl></dl>", False),
        ("dl.t > dd", "<dl class=t><div><dd>b</div></dl>", False),
        ("dl.t > dd", "<dl class=t><dt>a<dl><dd>c</dl><dd>b</dl>", True),
        ("ul > li", "<ul><li>a<li>b<p>c<li>d", True),
        ("li > ul > li.x", "<ul><li>a<ul><li class=x>b</ul></ul>", True),
        ("p > div", "<p>a<div>b</div>", False),
        ("div > p", "<p>a<div><p>b</div>", True),
        ("div.a > i", "<div class=a><br><img><i>", True),
        ("div.a > i", "<div class=a /><i>", True),
        ("div.a i", "<div class=a></span></b></div></div><i>", False),
        ("tr > td.x", "<table><tr><td>a<td class=x>b<tr><td>c", True),
        ("article[data-e], .card", "<article>", False),
        ("article[data-e], .card", "<article data-e>", True),
        ("article[data-e], .card", "<div class='card big'>", True),
        ("a b c", "<a><c><b></b></c></a>", False),
        ("a b c", "<a><x><b><y><c>", True),
        ("a > b c", "<a><x><b><c>", False),
        ("x x", "<x></x><x></x>", False),
        ("x x", "<x><x>", True),
    ],
)
def test_selector(selector, html, found):
    assert (missing(html, s=selector) == []) is found


def test_labels_keep_their_order_and_empty_pages_lack_all():
    selectors = {"one": "h1", "two": "h2.x", "three": "ul li"}
    assert missing("<h2 class=x>", **selectors) == ["one", "three"]
    assert missing(None, **selectors) == missing("", **selectors) == list(selectors)


@pytest.mark.parametrize("selector", ["h2:first-child", "h2 + p", "[a=b]", "h2[", "a >> b", ""])
def test_other_selectors_are_errors(selector):
    with pytest.raises(ValueError, match="unsupported selector"):
        SelectorList([("s", selector)])


def test_walk_is_linear():
    def seconds(n):
        html = "<div><b>" * n + "</span><li>" * n + "<p><dt>" * n
        start = time.perf_counter()
        missing(html, a="div.none > li", b="dl dt")
        return time.perf_counter() - start

    seconds(100)
    assert seconds(20_000) < 40 * max(seconds(2_000), 0.002)


def test_mixed_table(spark):
    rows = [
        (1, "html_monthly_dl_pairs", '<div class="schedule_box"><h3 class="ttl">5</h3><dl class="text_box"><dt>1<dd><p class="event_name">x</dl></div>', "text/html"),
        (2, "html_monthly_dl_pairs", '<div class="schedule_box"><dl class="text_box"><dt>1</dl></div>', None),
        (3, "html_heading_page", "<h1>a</h1>", None),
        (4, "html_heading_page", None, None),
        (5, "json_feed", '[{"title": "x"}]', "application/json"),
        (6, "json_feed", "{", None),
        (7, "no_such_shape", "<h1>", None),
        (8, None, "<h1>", None),
        (9, "html_card_listing", "<p>", None),
    ]
    table = spark.createDataFrame(rows, "id int, expected_shape string, html string, content_type string")
    got = {r["id"]: (r["matched"], r["summary"]) for r in pages.check_page_shapes(table).collect()}
    assert got == {
        1: (True, "matched selectors [schedule_box, month_heading, schedule_dt, schedule_dd, event_name] content_type=text/html"),
        2: (False, "missing selectors [month_heading, schedule_dd, event_name]"),
        3: (True, "matched selectors [heading]"),
        4: (False, "missing selectors [heading]"),
        5: (True, "matched JSON feed rows=1 content_type=application/json"),
        6: (False, "failed to parse JSON feed"),
        7: (False, "unknown expected shape"),
        8: (False, "unknown expected shape"),
        9: (False, "missing selectors [event_card]"),
    }
    # each row as the check of its shape alone
    for shape in {r[1] for r in rows} - {"no_such_shape", None}:
        for r in pages.check_shape(table.where(F.col("expected_shape") == shape), shape).collect():
            assert got[r["id"]] == (r["matched"], r["summary"])
    assert pages.check_page_shapes(table.limit(0)).collect() == []


def test_cards_in_linear_time():
    def walk(n):
        parser = pages._Cards()
        start = time.perf_counter()
        parser.feed("<div>" * n + "<article data-crawl-event><h2>a <b>b</b></h2>c</span><h3>d</h3></article>" * n + "</span>" * n)
        parser.close()
        return parser.cards, time.perf_counter() - start

    cards, short = walk(1_000)
    assert len(cards) == 1_000 and all("".join(c["title"]) == "a b" for c in cards)
    assert walk(10_000)[1] < 40 * max(short, 0.002)


def test_nested_cards_keep_their_titles():
    parser = pages._Cards()
    parser.feed('<article data-crawl-event><time datetime=1><div class="crawl-event-card"><h2>in</div><i data-placement-tag=home>x</i><h3>out</h3></article><h2>no')
    parser.close()
    assert [("".join(c["title"]), c["time"], c["tags"]) for c in parser.cards] == [("in", "1", ["home"]), ("in", None, [])]


def test_pages_are_spread_before_the_walk(spark, tmp_path):
    """The parts table is one small file; its pages are walked in as many tasks as a shuffle has."""
    from types import SimpleNamespace

    from wayside.plans import q_pages

    parts = spark.range(40).select(F.col("id").alias("p_partkey"), F.concat(F.lit("n"), "id").alias("p_name"))
    parts.coalesce(1).write.parquet(f"{tmp_path}/part")
    rows = q_pages.shaped_pages(SimpleNamespace(source=lambda name: spark.read.parquet(f"{tmp_path}/{name}")))
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and rows.count() == 40
