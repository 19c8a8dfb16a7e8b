"""Queries over captured pages, their events and the health of page runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayside.operators import crawl_health, pages, quality
from wayside.plans.registry import extra_tables, query
from wayside.plans.testmap import as_of
from wayside.session import spread

_C = F.col


def _s(key):
    return (_C(key) if isinstance(key, str) else key).cast("string")


def captured(m):
    """The page table as captures: source by first letter of the host."""
    return m.source("pages").select(
        F.lit("web").alias("source_id"), F.concat(F.lit("t"), _s("page_id")).alias("logical_name"), _C("url").alias("target_url"), "html",
        F.lit("text/html").alias("content_type"), "page_id",
    )


def targets(m):
    k = _C("page_id")
    return m.source("pages").select(
        F.lit("web").alias("source_id"), F.concat(F.lit("t"), _s("page_id")).alias("logical_name"), F.concat(F.lit("s"), _s(k % 120)).alias("school_id"),
        F.lit("general").alias("event_category"), (k % 2 == 0).alias("is_open_day"), F.lit(False).alias("is_featured"), F.lit(0.5).alias("priority_weight"),
        F.array(F.lit("home")).alias("placement_tags"),
    )


@query(
    "resolve_targets",
    """SELECT 't' || p_partkey AS logical_name, 's' || CASE WHEN p_partkey % 4 = 0 THEN p_partkey ELSE p_partkey // 10 END AS school_id, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE 'general' END AS event_category,
        p_partkey % 2 = 0 AS is_open_day, CASE WHEN p_partkey % 7 = 1 THEN 'URL must not be empty' END AS reason FROM part""",
)
def _targets(m):
    k = _C("p_partkey")
    none = F.lit(None)
    t = F.struct(
        F.concat(F.lit("t"), _s(k)).alias("logical_name"), F.when(k % 7 == 1, F.lit(" ")).otherwise(F.lit("https://a.example/x")).alias("url"),
        F.when(k % 4 == 0, F.concat(F.lit("s"), _s(k))).alias("school_id"), F.when(k % 3 == 0, F.lower("p_type")).alias("event_category"),
        F.when(k % 2 == 0, F.lit(True)).alias("is_open_day"), none.cast("boolean").alias("is_featured"), none.cast("double").alias("priority_weight"),
        none.cast("array<string>").alias("placement_tags"),
    )
    group = F.floor(k / 10).cast("long")
    defaults = F.struct(
        F.concat(F.lit("s"), _s(_C("g"))).alias("school_id"), none.cast("string").alias("event_category"), F.lit(False).alias("is_open_day"), F.lit(False).alias("is_featured"),
        F.lit(0.0).alias("priority_weight"), F.array().cast("array<string>").alias("placement_tags"),
    )
    sources = m.source("part").select(group.alias("g"), t.alias("t")).groupBy("g").agg(F.collect_list("t").alias("targets"))
    ok, bad = pages.resolve_targets(sources.select(_s("g").alias("source_id"), F.lit("k").alias("parser_key"), defaults.alias("defaults"), "targets"))
    cols = ["logical_name", "school_id", "event_category", "is_open_day"]
    return ok.select(*cols, F.lit(None).cast("string").alias("reason")).unionByName(bad.select(*cols, "reason"))


@query(
    "allowlist",
    """SELECT page_id, reason IS NULL AS allowed, reason FROM (SELECT page_id, CASE WHEN page_id % 10 = 3 THEN 'unsupported URL scheme ftp' WHEN page_id % 10 = 4 THEN 'host 10.0.0.1 is private or local and must be explicitly allowed'
        WHEN NOT (host = 'example.com' OR host LIKE '%.example.com' OR host LIKE '%.example.org') THEN 'host ' || host || ' is outside the crawler allowlist' END AS reason
       FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages))""",
)
def _allow(m):
    k = _C("page_id")
    urls = m.source("pages").select(
        "page_id",
        F.when(k % 10 == 3, F.regexp_replace("url", "^https?:", "ftp:")).when(k % 10 == 4, F.lit("http://10.0.0.1/x")).otherwise(_C("url")).alias("url"),
    )
    domains = m.spark.createDataFrame([(".Example.com",), ("example.org ",), ("0.0.1",)], "domain string")
    return pages.allowlist(urls, domains).select("page_id", "allowed", "reason")


def robots_files(m):
    """One robots text per host of the page table."""
    hosts = m.source("pages").select(F.try_parse_url("url", F.lit("HOST")).alias("host")).distinct()
    body = (
        "# rules\nUser-agent: *\nDisallow: /en/\nAllow: /en/67\nUser-agent: Fast\nUser-agent: slow # two names\nDisallow: /fr/\n\n"
        "Disallow: /nobody\nUser-agent: fastbot\nDisallow:\nAllow: /es\nDisallow: /es"
    )
    return hosts.withColumn("body", F.lit(body))


query(
    "parse_robots",
    """SELECT host, agents, allow, path FROM (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages),
        (VALUES ('*', false, '/en/'), ('*', true, '/en/67'), ('fast,slow', false, '/fr/'), ('fastbot', false, '/nobody'), ('fastbot', false, ''), ('fastbot', true, '/es'), ('fastbot', false, '/es')) v(agents, allow, path)""",
)(lambda m: pages.parse_robots(robots_files(m)).select("host", F.array_join("agents", ",").alias("agents"), "allow", "path"))


@query(
    "robots_decision",
    """SELECT page_id, user_agent, CASE agent WHEN 'a' THEN path LIKE '/en/67%' OR path NOT LIKE '/en/%' WHEN 'f' THEN path NOT LIKE '/fr/%' ELSE path NOT LIKE '/nobody%' END AS allowed
        FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, unnest(['Other', 'FastX', 'FastBot/2.0']) AS user_agent, unnest(['a', 'f', 'b']) AS agent FROM pages)""",
)
def _robots(m):
    urls = m.source("pages").select(
        "page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")).alias("path"),
        F.explode(F.array(F.lit("Other"), F.lit("FastX"), F.lit("FastBot/2.0"))).alias("user_agent"),
    )
    return pages.robots_decision(urls, pages.parse_robots(robots_files(m))).select("page_id", "user_agent", "allowed")


def fetch_history(m):
    """A fetch log made of the events: checksum by type, none for errors."""
    k = _C("user_id")
    return m.source("events").select(
        _C("event_id").alias("id"), F.concat(F.lit("m"), _s(k % 3)).alias("manifest"), F.when(_C("event_id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("n"), _s(k % 10))).alias("logical_name"),
        F.lit("https://a.example/").alias("target_url"), F.when(_C("event_type") != "error", F.sha2("event_type", 256)).alias("checksum_sha256"),
        _C("ts").cast("timestamp_ntz").alias("fetched_at"),
        F.when(_C("event_type") == "error", F.concat(F.when(_C("event_id") % 2 == 0, F.lit("bad response body ")).otherwise(F.lit("timeout ")), _s("event_id"))).alias("error_message"),
    )


extra_tables(
    x_history="""SELECT event_id AS id, 'm' || (user_id % 3) AS manifest, CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 'n' || (user_id % 10) END AS logical_name,
            CASE WHEN event_type <> 'error' THEN sha256(event_type) END AS checksum, ts AS fetched_at FROM events"""
)
query(
    "content_changes",
    """SELECT id, checksum AS checksum_sha256, prev AS previous_checksum, NOT coalesce(prev = checksum, false) AS content_changed, CASE WHEN prev = checksum THEN 'not_modified' ELSE 'fetched' END AS content_status
       FROM (SELECT *, last_value(checksum IGNORE NULLS) OVER (PARTITION BY manifest, logical_name ORDER BY fetched_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM x_history)""",
)(lambda m: pages.content_changes(fetch_history(m)).select("id", "checksum_sha256", "previous_checksum", "content_changed", "content_status"))
query(
    "latest_fetches",
    "SELECT id, manifest, logical_name, fetched_at FROM x_history ORDER BY id DESC LIMIT 10",
)(lambda m: quality.latest(fetch_history(m), [_C("id").desc()], 10).select("id", "manifest", "logical_name", "fetched_at"))
query(
    "classify_fetch_errors",
    "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'blocked_policy' ELSE 'fetch_failed' END AS fetch_status FROM events WHERE event_type = 'error'",
)(lambda m: pages.classify_fetch_errors(fetch_history(m).where("error_message IS NOT NULL")).select("id", "fetch_status"))

_UNESCAPE = "replace(replace(replace(replace({0}, '&amp;', '&'), '&middot;', '·'), '&copy;', '©'), '&quot;', '\"')"
_H1 = "trim(regexp_replace(" + _UNESCAPE.format("regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1), '(?s)<[^>]*>', '', 'g')") + ", '\\s+', ' ', 'g'))"
extra_tables(
    x_heading=f"SELECT page_id, 't' || page_id AS logical_name, url, {_H1} AS title FROM pages",
    x_page_events="""SELECT 'crawl_web_' || left(sha256('web' || chr(0) || 's' || (page_id % 120) || chr(0) || translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || chr(0)), 16) AS event_id, 's' || (page_id % 120) AS school_id, title,
            page_id % 2 = 0 AS is_open_day, logical_name, url AS target_url, page_id FROM x_heading""",
)
query("extract_heading", "SELECT logical_name, title, CAST(NULL AS VARCHAR) AS starts_at FROM x_heading WHERE title <> ''")(
    lambda m: pages.extract_heading(captured(m))[0].select("logical_name", "title", "starts_at")
)
query(
    "check_shape",
    """SELECT page_id, regexp_matches(html, '(?i)<h1[\\s>]') AS heading, regexp_matches(html, 'data-crawl-event|crawl-event-card') AS cards, false AS feed,
        'missing selectors [event_card] content_type=text/html' AS card_summary FROM pages""",
)(
    lambda m: pages.check_shape(
        pages.check_shape(
            pages.check_shape(captured(m), "html_heading_page").withColumn("heading", _C("matched")).drop("matched", "summary"), "html_card_listing"
        ).withColumns({"cards": _C("matched"), "card_summary": _C("summary")}).drop("matched", "summary"),
        "json_feed",
    ).select("page_id", "heading", "cards", _C("matched").alias("feed"), "card_summary")
)


#: Per shape and label: markup that has it, and markup that only looks like it.
SHAPE_PIECES = {
    "html_keio_event_cards": [
        ("card_link", '<a href="/x">x</a>', "<a name=x>x</a>"),
        ("card_title", "<h2>x</h2>", "<!-- <h2>x</h2> -->"),
        ("card_date", '<div class="a _cardEventDate_9 b">x</div>', '<div data-class="_cardEventDate_">x</div>'),
    ],
    "html_school_tour_blocks": [
        ("school_tour_schedule", '<section class="explan1"><div><dl><dt>x</dl></div></section>', '<section class="explan1"></section><dl><dt>x</dl>'),
        ("school_tour_date", '<section class="a explan1"><p class="date">x</section>', '<section class="explan12"><p class="date">x</section>'),
        (
            "external_event_rows",
            '<section class="explan3"><div class="tbody"><div class="table">x</div></div></section>',
            '<section class="explan3"><div class="tbody"><i><b class="table">x</b></i></div></section>',
        ),
    ],
    "html_qua_sections": [
        ("container", '<div class="qua-container">x</div>', '<p class="qua-container">x</p>'),
        ("section_heading", '<h4 class="qua-wysiwyg-content">x</h4>', '<h3 class="qua-wysiwyg-content">x</h3>'),
        (
            "dated_item",
            '<div class="qua-field-list"><ul><li>x<li class="qua-field-list__item">x</ul></div>',
            '<div class="qua-field-list"></div><ul><li class="qua-field-list__item">x</ul>',
        ),
    ],
    "html_session_tables": [
        ("page_title", '<h3 class="m_c-pagetitle02_x">x</h3>', """<script>"<h3 class='c-pagetitle02'>"</script>"""),
        ("session_table", '<table class="c-table02"><tr><td>x</table>', '<table class="c-table021"><tr><td>x</table>'),
    ],
    "html_monthly_dl_pairs": [
        ("schedule_box", '<div class="schedule_box">x</div>', '<div id="schedule_box">x</div>'),
        ("month_heading", '<h3 class="ttl">x</h3>', '<h3>ttl</h3>'),
        ("schedule_dt", '<dl class="text_box"><dt>x</dl>', '<dl class="text_box"><div><dt>x</div></dl>'),
        ("schedule_dd", '<dl class="text_box"><p>x</p><dd>x</dl>', '<dl class="text_box"><p>x</p><dl><dd>x</dl></dl>'),
        ("event_name", '<p class="event_name">x', '<span class="event_name">x</span>'),
    ],
}
_EVERY = [3, 7, 11, 13, 17]


def shaped_pages(m):
    """A page per part in one of the shapes, each label absent from every third, seventh, ... page."""
    k, shapes = _C("p_partkey"), list(SHAPE_PIECES)
    body = F.lit(None)
    for i, pieces in enumerate(SHAPE_PIECES.values()):
        each = [F.when(k % n == 0, F.lit(absent)).otherwise(F.lit(present)) for n, (_, present, absent) in zip(_EVERY, pieces, strict=False)]
        body = F.when(k % 5 == i, F.concat(*each)).otherwise(body)
    page = F.concat(F.lit("<!DOCTYPE html><html><head><title>"), "p_name", F.lit("</title></head><body>"), body, F.lit("</body></html>"))
    # the walk over a page's tags costs far more than its row weighs, and a small table is one file
    return spread(m.source("part"), "p_partkey").select(
        k.alias("page_id"), F.element_at(F.array(*[F.lit(s) for s in shapes]), (k % 5 + 1).cast("int")).alias("expected_shape"), page.alias("html"),
        F.when(k % 2 == 0, F.lit("text/html")).alias("content_type"),
    )


def _shapes_sql() -> str:
    shape = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SHAPE_PIECES))
    names = " ".join(f"WHEN {i} THEN '{', '.join(label for label, _, _ in pieces)}'" for i, pieces in enumerate(SHAPE_PIECES.values()))
    lacks = " ".join(
        f"WHEN {i} THEN concat_ws(', ', {', '.join(f'CASE WHEN p_partkey % {n} = 0 THEN {chr(39)}{label}{chr(39)} END' for n, (label, _, _) in zip(_EVERY, pieces, strict=False))})"
        for i, pieces in enumerate(SHAPE_PIECES.values())
    )
    return f"""SELECT page_id, expected_shape, lacks = '' AS matched,
        CASE WHEN lacks = '' THEN 'matched selectors [' || names ELSE 'missing selectors [' || lacks END || ']' || CASE WHEN page_id % 2 = 0 THEN ' content_type=text/html' ELSE '' END AS summary
        FROM (SELECT p_partkey AS page_id, CASE p_partkey % 5 {shape} END AS expected_shape, CASE p_partkey % 5 {names} END AS names, CASE p_partkey % 5 {lacks} END AS lacks FROM part)"""


query("page_shapes", _shapes_sql())(lambda m: pages.check_page_shapes(shaped_pages(m)).select("page_id", "expected_shape", "matched", "summary"))


def faulty_seeds(m):
    """Each page's seed twice more: for a target that is not there, and without a title."""
    seeds = pages.extract_heading(captured(m))[0].where("trim(title) <> ''")
    return seeds.unionByName(seeds.withColumn("source_id", F.lit("nowhere"))).unionByName(seeds.withColumn("title", F.lit("  "))), targets(m)


def finalized(m):
    return pages.finalize_events(pages.extract_heading(captured(m))[0], targets(m))


query("finalize_events", "SELECT event_id, school_id, title, is_open_day, logical_name, '{}' AS details FROM x_page_events WHERE title <> ''")(
    lambda m: finalized(m).select("event_id", "school_id", "title", "is_open_day", "logical_name", "details")
)
query(
    "rejected_seeds",
    """SELECT logical_name, CASE WHEN part = 1 THEN 'unknown target' ELSE 'blank title' END AS message FROM x_page_events, (VALUES (1), (2)) v(part) WHERE title <> ''""",
)(lambda m: pages.rejected_seeds(*faulty_seeds(m)).select("logical_name", "message"))
query(
    "dedupe_events",
    """WITH e AS (SELECT *, 'k' || (page_id % 90) AS k FROM x_page_events), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY logical_name, target_url, title) AS rn FROM e)
       SELECT k AS event_id, logical_name, 'kept' AS outcome FROM r WHERE rn = 1 UNION ALL SELECT k, logical_name, 'dropped' FROM r WHERE rn > 1""",
)(
    lambda m: (lambda kept, report: kept.select("event_id", "logical_name", F.lit("kept").alias("outcome")).unionByName(
        report.select(_C("dedupe_key").alias("event_id"), _C("dropped_logical_name").alias("logical_name"), F.lit("dropped").alias("outcome"))
    ))(*pages.dedupe_events(finalized(m).withColumn("event_id", F.concat(F.lit("k"), _s(F.expr("cast(substring(logical_name, 2) as int)") % 90)))))
)


# cards and feeds whose markup Spark makes of the part table
def card_pages(m):
    k = _C("p_partkey")
    attr = F.concat(
        F.lit(' data-category="'), F.lower("p_type"), F.lit('"'), F.when(k % 2 == 0, F.lit(' data-open-day="Yes"')).otherwise(F.lit("")),
        F.when(k % 3 == 0, F.lit(' data-placement-tags="home| search"')).otherwise(F.lit("")), F.lit(' data-priority-weight="'), _s(k % 5), F.lit('.5"'),
        F.when(k % 200 == 7, F.lit(' data-featured="perhaps"')).otherwise(F.lit("")),
    )
    head = F.when(k % 5 == 0, F.lit('<div class="x crawl-event-card"')).otherwise(F.lit("<article data-crawl-event"))
    tail = F.when(k % 5 == 0, F.lit("</div>")).otherwise(F.lit("</article>"))
    card = F.concat(
        head, attr, F.lit("><p>n<br></p><h3> <b>"), _C("p_name"), F.lit("</b>\n &amp; "), _s(k), F.lit('</h3><time datetime="2024-05-0'), _s(k % 9 + 1), F.lit('">x</time>'),
        F.when(k % 3 == 1, F.lit('<i data-placement-tag=" detail">d</i>')).otherwise(F.lit("")), tail,
    )
    rows = m.source("part").select(F.floor(k / 10).cast("long").alias("g"), F.struct(k.alias("k"), card.alias("c")).alias("c"))
    body = rows.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["c"]), "\n").alias("body"))
    # one page in ten (of those with cards) is left without any
    return body.select(
        F.lit("cards").alias("source_id"), F.concat(F.lit("p"), _s("g")).alias("logical_name"), F.concat(F.lit("https://c.example/"), _s("g")).alias("target_url"),
        F.concat(F.lit("<html><body>"), F.when(_C("g") % 17 == 5, F.lit("<p>none</p>")).otherwise(_C("body")), F.lit("</body></html>")).alias("html"), F.lit("card_listing_v1").alias("parser_key"),
    )


_CARD = "p_partkey // 10 % 17 <> 5 AND p_partkey // 10 NOT IN (SELECT p_partkey // 10 FROM part WHERE p_partkey % 200 = 7)"
query(
    "extract_cards",
    f"""SELECT 'p' || (p_partkey // 10) AS logical_name, p_name || ' & ' || p_partkey AS title, '2024-05-0' || (p_partkey % 9 + 1) AS starts_at, lower(p_type) AS seed_category,
        CASE WHEN p_partkey % 2 = 0 THEN true END AS seed_open_day, p_partkey % 5 + 0.5e0 AS seed_weight, CASE p_partkey % 3 WHEN 0 THEN 'home,search' WHEN 1 THEN 'detail' END AS tags FROM part WHERE {_CARD}""",
)(
    lambda m: pages.extract_cards(card_pages(m))[0].select("logical_name", "title", "starts_at", "seed_category", "seed_open_day", "seed_weight", F.array_join("seed_tags", ",").alias("tags"))
)


def feed_pages(m):
    k = _C("p_partkey")
    entry = F.to_json(
        F.struct(
            F.when(k % 11 != 3, _C("p_name")).alias("pageTitle"), F.concat(F.lit("2024/"), _s(k % 12 + 1), F.lit("/"), _s(k % 28 + 1)).alias("eventStartDate"),
            F.when(k % 13 != 4, F.concat(F.lit("/e/"), _s(k))).alias("url"), F.lower("p_type").alias("eventType"), F.when(k % 3 == 0, _C("p_brand")).alias("eventArea"),
        )
    )
    rows = m.source("part").select(F.floor(k / 100).cast("long").alias("g"), entry.alias("e")).groupBy("g").agg(F.array_join(F.array_sort(F.collect_list("e")), ",").alias("b"))
    return rows.select(
        F.lit("feed").alias("source_id"), F.concat(F.lit("p"), _s("g")).alias("logical_name"), F.concat(F.lit("https://f.example/"), _s("g")).alias("target_url"),
        F.concat(F.lit("["), _C("b"), F.lit("]")).alias("html"), F.lit("json_feed_v1").alias("parser_key"), F.lit("application/json").alias("content_type"),
    )


extra_tables(
    x_feed_rows="""SELECT p_partkey // 100 AS g, p_name AS title, printf('2024-%02d-%02d', p_partkey % 12 + 1, p_partkey % 28 + 1) AS starts_at, 'https://f.example/e/' || p_partkey AS detail_url,
            p_partkey % 11 = 3 AS no_title, p_partkey % 13 = 4 AS no_url,
            '{"event_type":"' || lower(p_type) || '"' || CASE WHEN p_partkey % 3 = 0 THEN ',"event_area":"' || p_brand || '"' ELSE '' END || '}' AS details FROM part"""
)
query(
    "extract_json_feed",
    """SELECT 'p' || g AS logical_name, title, starts_at, detail_url, details FROM x_feed_rows WHERE NOT no_title AND NOT no_url""",
)(lambda m: pages.extract_json_feed(feed_pages(m), "https://f.example")[0].select("logical_name", "title", "starts_at", "detail_url", "details"))
query(
    "extract_json_feed_newest",
    """SELECT 'p' || g AS logical_name, title, starts_at, detail_url FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY starts_at DESC, title, detail_url) AS rn
        FROM x_feed_rows WHERE NOT no_title AND NOT no_url) WHERE rn <= 60""",
)(lambda m: pages.extract_json_feed(feed_pages(m), "https://f.example", limit=60)[0].select("logical_name", "title", "starts_at", "detail_url"))
query(
    "feed_drop_counts",
    """SELECT 'p' || g AS logical_name, count(*) AS input_rows, count(*) FILTER (WHERE no_title) AS dropped_missing_title, count(*) FILTER (WHERE NOT no_title AND no_url) AS dropped_missing_url,
       least(count(*) FILTER (WHERE NOT no_title AND NOT no_url), 60) AS kept_rows, greatest(count(*) FILTER (WHERE NOT no_title AND NOT no_url) - 60, 0) AS cut_rows
       FROM x_feed_rows GROUP BY g""",
)(lambda m: pages.feed_drop_counts(feed_pages(m), limit=60).drop("target_url"))
query(
    "json_feed_shape",
    "SELECT 'p' || g AS logical_name, true AS matched, 'matched JSON feed rows=' || count(*) || ' content_type=application/json' AS summary FROM x_feed_rows GROUP BY g",
)(lambda m: pages.check_shape(feed_pages(m), "json_feed").select("logical_name", "matched", "summary"))


def routed(m):
    cols = ["source_id", "logical_name", "target_url", "html", "parser_key"]
    web = captured(m).withColumn("parser_key", F.when(_C("page_id") % 50 == 9, F.lit("other_v1")).otherwise(F.lit("single_title_page_v1")))
    every = web.select(*cols).unionByName(card_pages(m).select(*cols)).unionByName(feed_pages(m).select(*cols))
    parsers = {
        "single_title_page_v1": pages.extract_heading,
        "card_listing_v1": pages.extract_cards,
        "json_feed_v1": lambda p: pages.extract_json_feed(p, "https://f.example"),
    }
    return pages.extract_events(every, parsers)


query(
    "parse_reports",
    f"""SELECT level, code, count(*) AS pages, CAST(sum(parsed_rows) AS BIGINT) AS parsed_rows FROM (
        SELECT 'info' AS level, 'events_extracted' AS code, 1 AS parsed_rows FROM pages WHERE page_id % 50 <> 9
        UNION ALL SELECT 'error', 'parse_failed', NULL FROM pages WHERE page_id % 50 = 9
        UNION ALL SELECT 'info', 'events_extracted', count(*) FROM part WHERE {_CARD} GROUP BY p_partkey // 10
        UNION ALL SELECT 'warn', 'parsed_zero_rows', 0 FROM part WHERE p_partkey // 10 % 17 = 5 GROUP BY p_partkey // 10
        UNION ALL SELECT 'error', 'parse_failed', NULL FROM part WHERE p_partkey % 200 = 7 AND p_partkey // 10 % 17 <> 5
        UNION ALL SELECT 'info', 'events_extracted', count(*) FROM x_feed_rows WHERE NOT no_title AND NOT no_url GROUP BY g) GROUP BY 1, 2""",
)(
    lambda m: pages.parse_reports(*routed(m)).groupBy("level", "code").agg(F.count(F.lit(1)).alias("pages"), F.sum("parsed_rows").alias("parsed_rows"))
)

# dates
_D = "o_orderdate"
query(
    "dates_japanese",
    """SELECT o_orderkey, CAST(i - 1 AS INTEGER) AS date_pos, printf('%04d-%02d-%02d', year(o_orderdate), month(o_orderdate), CASE i WHEN 1 THEN day(o_orderdate) ELSE 28 END) AS date
       FROM orders, (VALUES (1), (2)) v(i) WHERE year(o_orderdate) >= 2000""",
)(
    lambda m: pages.extract_dates(
        m.source("orders").select(
            "o_orderkey",
            F.concat(F.lit("令和 "), _s(F.year(_D)), F.lit("年"), _s(F.month(_D)), F.lit("月"), _s(F.day(_D)), F.lit("日(土) 10時、28日・45日 3")).alias("text"),
        ),
        "japanese",
    ).select("o_orderkey", "date_pos", "date")
)
query(
    "dates_academic",
    """SELECT o_orderkey, printf('%04d-%02d-%02d', 2024 + CASE WHEN month(o_orderdate) >= 4 THEN 0 ELSE 1 END, month(o_orderdate), day(o_orderdate)) AS date FROM orders
       UNION SELECT o_orderkey, '2024-09-03' FROM orders""",
)(
    lambda m: pages.extract_dates(
        m.source("orders").select(
            "o_orderkey", F.concat(F.lit("第1回 "), _s(F.month(_D)), F.lit("/"), _s(F.day(_D)), F.lit(" と "), _s(F.month(_D)), F.lit("/"), _s(F.day(_D)), F.lit(" 99/3 a/4")).alias("text"), F.lit(2024).alias("academic_year")
        ),
        "academic",
    ).select("o_orderkey", "date")
)
query(
    "dates_url",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE year(o_orderdate) >= 2000",
)(
    lambda m: pages.extract_dates(
        m.source("orders").select("o_orderkey", F.concat(F.lit("https://a.example/123/19991332/"), F.date_format(_D, "yyyyMMdd"), F.lit("01/x?d=20200101")).alias("text")),
        "url",
    ).select("o_orderkey", "date")
)


@query(
    "infer_years",
    """SELECT page, pos, printf('%04d-%02d-%02d', CASE WHEN dated IS NOT NULL THEN dated ELSE base + drops END, CASE WHEN dated IS NOT NULL THEN 1 ELSE month END, CASE WHEN dated IS NOT NULL THEN 2 ELSE day END) AS starts_at
       FROM (SELECT *, coalesce(last_value(dated IGNORE NULLS) OVER w, first_url) AS base, sum(CASE WHEN dated IS NULL AND month < prev THEN 1 ELSE 0 END) OVER (PARTITION BY page, run ORDER BY pos) AS drops
             FROM (SELECT *, lag(month) OVER w AS prev, count(dated) OVER w AS run, min_by(dated, pos) FILTER (WHERE dated IS NOT NULL) OVER (PARTITION BY page) AS first_url
                   FROM (SELECT o_custkey AS page, o_orderkey AS pos, month(o_orderdate) AS month, day(o_orderdate) AS day, CASE WHEN o_orderkey % 4 = 0 THEN year(o_orderdate) END AS dated FROM orders)
                   WINDOW w AS (PARTITION BY page ORDER BY pos)) WINDOW w AS (PARTITION BY page ORDER BY pos)) WHERE base IS NOT NULL""",
)
def _years(m):
    rows = m.source("orders").select(
        _C("o_custkey").alias("page"), _C("o_orderkey").alias("pos"), F.month(_D).alias("month"), F.day(_D).alias("day"),
        F.when(_C("o_orderkey") % 4 == 0, F.concat(_s(F.year(_D)), F.lit("-01-02"))).alias("detail_url_date"),
    )
    return pages.infer_years(rows).where("starts_at IS NOT NULL").select("page", "pos", "starts_at")


query(
    "date_drift",
    "SELECT o_orderkey, 't title=x month_label=' || (month(o_orderdate) % 12 + CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END) || '月 detail_url_date=' || strftime(o_orderdate + INTERVAL 31 DAY, '%Y-%m-%d') AS warning FROM orders WHERE month(o_orderdate) % 12 + CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END <> month(o_orderdate + INTERVAL 31 DAY)",
)(
    lambda m: pages.date_drift(
        m.source("orders").select(
            "o_orderkey", F.lit("t").alias("logical_name"), F.lit("x").alias("title"),
            F.concat(_s(F.month(_D) % 12 + F.when(_C("o_orderkey") % 5 == 0, 0).otherwise(1)), F.lit("月")).alias("month_label"),
            F.date_format(F.date_add(_D, 31), "yyyy-MM-dd").alias("detail_url_date"),
        )
    ).select("o_orderkey", "warning")
)


# import
def as_rows(m):
    """Parsed page events in the columns of the events table."""
    e, _ = pages.dedupe_events(finalized(m))
    return e.select(
        _C("event_id").alias("id"), "school_id", "title", "event_category", "is_open_day", "is_featured", "priority_weight",
        F.lit(None).cast("timestamp_ntz").alias("starts_at"), "placement_tags", "details",
    )


def _imported(m, fit_only: bool):
    new = as_rows(m)
    if fit_only:
        new = new.join(m.schools.select(_C("id").alias("school_id")), "school_id", "left_semi")
    events = m.events.withColumn("source_key", F.when(_C("source_type") == "crawl", F.lit("web")).otherwise(_C("source_key")))
    return pages.import_events(events, new, m.schools, "crawl", "web", True, as_of())


extra_tables(x_new="SELECT event_id AS id, any_value(school_id) AS school_id FROM x_page_events WHERE title <> '' GROUP BY 1")
query(
    "import_events",
    """SELECT id, source_type, is_active FROM (SELECT id, source_type, is_active AND source_type <> 'crawl' AS is_active FROM m_events
       UNION ALL SELECT id, 'crawl', true FROM x_new WHERE school_id IN (SELECT id FROM m_schools))""",
)(lambda m: _imported(m, True)[0].select("id", "source_type", "is_active"))
query(
    "import_events_reports",
    """SELECT 'info' AS level, 'crawl_imported' AS code, (SELECT count(*) FROM x_new WHERE school_id IN (SELECT id FROM m_schools)) AS row_count
       UNION ALL SELECT 'warn', 'crawl_missing_school', (SELECT count(*) FROM x_new WHERE school_id NOT IN (SELECT id FROM m_schools))
       UNION ALL SELECT 'warn', 'crawl_skipped_missing_school_deactivation', (SELECT count(*) FROM x_new WHERE school_id NOT IN (SELECT id FROM m_schools))""",
)(lambda m: _imported(m, False)[1])
query(
    "import_impact",
    """SELECT (SELECT count(*) FROM x_page_events WHERE title <> '') AS parsed_rows, (SELECT count(*) FROM x_new) AS deduped_rows, (SELECT count(*) FROM x_new WHERE school_id IN (SELECT id FROM m_schools)) AS imported_rows,
        (SELECT count(*) FROM x_new WHERE school_id NOT IN (SELECT id FROM m_schools)) AS missing_school_rows, CAST(0 AS BIGINT) AS deactivated_rows,
        'missing_school_id,missing_school_skips_stale_deactivation' AS warnings""",
)(lambda m: pages.import_impact(m.events, finalized(m), m.schools, "web", True).withColumn("warnings", F.array_join("warnings", ",")))


# run health, on orders as runs and line items as fetches
def crawl_runs(m):
    return m.source("orders").select(
        _C("o_orderkey").alias("id"), F.concat(F.lit("m"), _s(_C("o_custkey") % 40)).alias("manifest"),
        F.when(_C("o_orderstatus") == "F", "succeeded").when(_C("o_orderstatus") == "O", "fetched").otherwise("failed").alias("status"),
    )


def _line_id():
    return _C("l_orderkey") * 100_000_000 + _C("l_partkey") * 1000 + _C("l_suppkey") * 8 + _C("l_linenumber")


def crawl_logs(m):
    return m.source("lineitem").select(
        _line_id().alias("id"), _C("l_orderkey").alias("crawl_run_id"), F.concat(F.lit("t"), _s(_C("l_suppkey") % 4)).alias("logical_name"),
        F.when(_C("l_returnflag") == "R", "fetch_failed").when(_C("l_returnflag") == "A", "fetched").otherwise("not_modified").alias("fetch_status"),
    )


def crawl_reports(m):
    return m.source("lineitem").select(
        _line_id().alias("id"), _C("l_orderkey").alias("crawl_run_id"), F.concat(F.lit("t"), _s(_C("l_suppkey") % 4)).alias("logical_name"),
        F.when(_C("l_quantity") < 8, "error").otherwise("info").alias("level"),
        F.when(_C("l_quantity") < 4, "parse_failed").when(_C("l_quantity") < 8, "parsed_zero_rows").otherwise("events_extracted").alias("code"), F.lit("m").alias("message"),
    )


extra_tables(
    x_runs="""SELECT o_orderkey AS id, 'm' || (o_custkey % 40) AS manifest, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'fetched' ELSE 'failed' END AS status FROM orders""",
    x_logs="""SELECT l_orderkey * 100000000 + l_partkey * 1000 + l_suppkey * 8 + l_linenumber AS id, l_orderkey AS crawl_run_id, 't' || (l_suppkey % 4) AS logical_name,
            CASE l_returnflag WHEN 'R' THEN 'fetch_failed' WHEN 'A' THEN 'fetched' ELSE 'not_modified' END AS fetch_status,
            CASE WHEN l_quantity < 8 THEN 'error' ELSE 'info' END AS level, CASE WHEN l_quantity < 4 THEN 'parse_failed' WHEN l_quantity < 8 THEN 'parsed_zero_rows' ELSE 'events_extracted' END AS code FROM lineitem""",
    x_recent_runs="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY manifest ORDER BY id DESC) - 1 AS i FROM x_runs) WHERE i < 10",
    x_signals="""SELECT crawl_run_id, logical_name, CASE WHEN bool_or(fetch_status = 'fetch_failed') THEN 'fetch_failed' WHEN bool_and(fetch_status = 'not_modified') THEN 'not_modified' ELSE 'fetched' END AS fs,
            max_by(code, id) FILTER (WHERE level = 'error') AS err FROM x_logs GROUP BY 1, 2""",
    x_grid="""SELECT r.manifest, t.logical_name, r.i, s.fs, s.err, s.crawl_run_id IS NOT NULL AS seen, s.crawl_run_id IS NULL OR s.fs = 'fetch_failed' OR s.err IS NOT NULL AS red,
            coalesce(s.fs <> 'fetch_failed' AND s.err IS NULL, false) AS green
        FROM x_recent_runs r CROSS JOIN (VALUES ('t0'), ('t1'), ('t2'), ('t3')) t(logical_name) LEFT JOIN x_signals s ON s.crawl_run_id = r.id AND s.logical_name = t.logical_name""",
    x_flagged="""SELECT manifest, logical_name, count(*) FILTER (WHERE seen) AS observed_runs, count(*) FILTER (WHERE green) AS successful_runs, count(*) FILTER (WHERE red) AS red_runs,
            CAST(coalesce(min(i) FILTER (WHERE NOT red), count(*)) AS BIGINT) AS consecutive_red_runs, bool_or(i = 0 AND NOT seen) AS missing, max(fs) FILTER (WHERE i = 0) AS latest_fetch_status, max(err) FILTER (WHERE i = 0) AS latest_error FROM x_grid GROUP BY 1, 2""",
    x_flag_reasons="""SELECT *, CASE WHEN observed_runs = 0 THEN ['no_recent_data'] ELSE list_filter([CASE WHEN missing THEN 'missing_from_latest_run' END, CASE WHEN latest_fetch_status = 'fetch_failed' THEN 'latest_fetch_failed' END,
            'latest_parse_error:' || latest_error, CASE WHEN successful_runs = 0 THEN 'no_successful_recent_runs' END, CASE WHEN red_runs >= 2 THEN 'repeated_recent_failures' END], lambda x: x IS NOT NULL) END AS reasons FROM x_flagged""",
)


query("latest_crawl_runs", "SELECT id, manifest, status FROM x_runs ORDER BY id DESC LIMIT 10")(lambda m: quality.latest(crawl_runs(m), [_C("id").desc()], 10))
query("latest_parse_reports", "SELECT crawl_run_id, logical_name, level, code FROM x_logs ORDER BY id DESC LIMIT 10")(
    lambda m: quality.latest(crawl_reports(m), [_C("id").desc()], 10).select("crawl_run_id", "logical_name", "level", "code")
)


def crawl_targets(m):
    return crawl_runs(m).select("manifest").distinct().withColumn("logical_name", F.explode(F.array(*[F.lit(f"t{i}") for i in range(4)])))


def _flags(m):
    return crawl_health.red_flags(crawl_targets(m), crawl_runs(m), crawl_logs(m), crawl_reports(m), 10)


query("latest_fetched", "SELECT manifest, max(id) AS crawl_run_id FROM x_runs WHERE status = 'fetched' GROUP BY 1")(lambda m: pages.latest_fetched(crawl_runs(m)))
query(
    "can_deactivate",
    """SELECT crawl_run_id, bool_and(fetch_status <> 'fetch_failed') AND NOT bool_or(code <> 'events_extracted') AS can_deactivate FROM x_logs GROUP BY 1""",
)(lambda m: pages.can_deactivate(crawl_logs(m), crawl_reports(m)))
query(
    "run_health",
    """SELECT r.manifest, r.id AS crawl_run_id, r.status, coalesce(count(*) FILTER (WHERE fetch_status = 'fetched'), 0) AS fetched, coalesce(count(*) FILTER (WHERE level = 'error'), 0) AS errors,
        max_by(code, l.id) FILTER (WHERE level = 'error') AS latest_error FROM x_recent_runs r LEFT JOIN x_logs l ON l.crawl_run_id = r.id GROUP BY 1, 2, 3""",
)(
    lambda m: crawl_health.run_health(crawl_runs(m), crawl_logs(m), crawl_reports(m), 10).select(
        "manifest", "crawl_run_id", "status", F.coalesce(F.element_at("fetch_status_counts", F.lit("fetched")), F.lit(0).cast("long")).alias("fetched"),
        F.coalesce(F.element_at("parse_level_counts", F.lit("error")), F.lit(0).cast("long")).alias("errors"), _C("latest_error.code").alias("latest_error"),
    )
)
query(
    "red_flags",
    """SELECT manifest, logical_name, observed_runs, successful_runs, red_runs, consecutive_red_runs, latest_fetch_status, latest_error, array_to_string(reasons, ',') AS reasons FROM x_flag_reasons WHERE len(reasons) > 0""",
)(lambda m: _flags(m).withColumn("reasons", F.array_join("reasons", ",")))
query(
    "reason_trend",
    """SELECT r.manifest, r.id AS crawl_run_id, r.status, reason, count(*) AS n FROM x_recent_runs r JOIN (SELECT crawl_run_id, 'fetch_failed' AS reason FROM x_logs WHERE fetch_status = 'fetch_failed'
        UNION ALL SELECT crawl_run_id, 'parse_error:' || code FROM x_logs WHERE level = 'error') x ON x.crawl_run_id = r.id GROUP BY 1, 2, 3, 4""",
)(lambda m: crawl_health.reason_trend(crawl_runs(m), crawl_logs(m), crawl_reports(m), 10))
extra_tables(
    x_reason_totals="""SELECT manifest, reason, count(*) AS n FROM (SELECT manifest, CASE WHEN r = 'latest_fetch_failed' THEN 'fetch_failed' WHEN r IN ('missing_from_latest_run', 'no_recent_data') OR r LIKE 'latest_parse_error:%' THEN r END AS reason
            FROM (SELECT manifest, unnest(reasons) AS r FROM x_flag_reasons)) WHERE reason IS NOT NULL GROUP BY 1, 2"""
)
query("reason_totals", "SELECT * FROM x_reason_totals")(lambda m: crawl_health.reason_totals(_flags(m)))


@query(
    "promotion_gate",
    """WITH h AS (SELECT manifest, count(*) FILTER (WHERE status = 'succeeded') AS ok, count(*) FILTER (WHERE status = 'failed') AS bad, count(*) FILTER (WHERE status = 'fetched') AS active FROM x_recent_runs GROUP BY 1),
        b AS (SELECT manifest, unnest(list_filter([CASE WHEN manifest LIKE '%3' THEN 'source_maturity_not_live_ready' END, CASE WHEN ok = 0 THEN 'no_succeeded_runs' END, CASE WHEN bad > 0 THEN 'recent_failed_runs' END,
                CASE WHEN manifest IN (SELECT manifest FROM x_flag_reasons WHERE len(reasons) > 0) THEN 'logical_name_red_flags' END], lambda x: x IS NOT NULL)) AS x FROM h
              UNION SELECT manifest, 'reason:' || reason FROM x_reason_totals)
       SELECT h.manifest, coalesce((SELECT array_to_string(list_sort(list(x)), ',') FROM b WHERE b.manifest = h.manifest), '') AS blockers, CASE WHEN active > 0 THEN 'active_runs,date_drift' ELSE 'date_drift' END AS review,
        CASE WHEN h.manifest IN (SELECT manifest FROM b) THEN 'blocked' ELSE 'review' END AS status FROM h""",
)
def _gate(m):
    sources = crawl_runs(m).select("manifest").distinct().withColumn("source_maturity", F.when(_C("manifest").endswith("3"), "prototype").otherwise("live_ready"))
    impact = sources.select(
        "manifest", F.lit(3).alias("ready_targets"), F.lit(9).alias("parsed_rows"), F.lit(9).alias("imported_rows"), F.lit(0).alias("missing_school_rows"),
        F.array(F.lit("date_drift")).alias("issues"),
    )
    gate = crawl_health.promotion_gate(sources, impact, crawl_runs(m), _flags(m), 10)
    return gate.withColumns({"blockers": F.array_join("blockers", ","), "review": F.array_join("review", ",")})
