"""Captured pages to events: policy, shape, extraction, dates, dedupe, import."""

from __future__ import annotations

import html
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayside import schemas
from wayside.functions.text import WHITE_SPACE, ascii_lower, non_blank, trimmed, truthy
from wayside.operators.normalize import absolute_url, clean_text, slash_date
from wayside.operators.selectors import VOID, missing_labels
from wayside.sources.sinks import upsert

# fixed values
BLOCKED_MARKERS = [
    "outside the crawler allowlist", "private or local", "unsupported URL scheme", "response content-type",
    "response Content-Length", "response body", "redirect count exceeded", "max_response_bytes",
]
ZERO_EVENT_MARKERS = [
    "did not find any event cards", "did not find any usable event rows", "did not find any school-tour rows",
    "did not find any dated event rows", "did not find any dated session rows", "did not find any schedule entries",
]
FEED_KEYS = ["pageTitle", "title", "url", "eventStartDate"]
PRIVATE_HOST = (
    r"^(localhost|0\.0\.0\.0|.*\.localhost|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2[0-9]|3[01])\..*"
    r"|\[?::1?\]?|\[?f[cd][0-9a-f]{2}:.*|\[?fe[89ab][0-9a-f]:.*|\[?ff[0-9a-f]{2}:.*)$"
)
# shape name -> [(label, pattern that the page must contain)]
HTML_SHAPES = {
    "html_heading_page": [("heading", r"(?i)<h1[\s>]")],
    "html_card_listing": [
        ("event_card", r"(?i)<article\b[^>]*\sdata-crawl-event\b|<\w+\b[^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?crawl-event-card[\s\"']")
    ],
}

#: Labels and selectors of the shapes with nested elements (fixed values).
SELECTOR_SHAPES = {
    "html_keio_event_cards": [("card_link", "a[href]"), ("card_title", "h2"), ("card_date", "div[class*='_cardEventDate_']")],
    "html_school_tour_blocks": [
        ("school_tour_schedule", "section.explan1 dl"),
        ("school_tour_date", "section.explan1 .date"),
        ("external_event_rows", "section.explan3 .tbody > .table"),
    ],
    "html_qua_sections": [
        ("container", "div.qua-container"),
        ("section_heading", "h4.qua-wysiwyg-content"),
        ("dated_item", "div.qua-field-list li.qua-field-list__item"),
    ],
    "html_session_tables": [("page_title", "h3[class*='c-pagetitle02']"), ("session_table", "table.c-table02")],
    "html_monthly_dl_pairs": [
        ("schedule_box", "div.schedule_box"),
        ("month_heading", "h3.ttl"),
        ("schedule_dt", "dl.text_box > dt"),
        ("schedule_dd", "dl.text_box > dd"),
        ("event_name", "p.event_name"),
    ],
}

SEED = [
    "title", "starts_at", "seed_school_id", "seed_category", "seed_open_day", "seed_featured", "seed_weight", "seed_tags", "detail_url", "details",
]
#: What a feed row tells about an event besides its title, start and address.
FEED_DETAILS = ["event_end_date", "event_type", "event_target", "event_area", "event_app", "busho"]


# --- policy ---------------------------------------------------------------


def resolve_targets(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets with the defaults of their source, and the unusable ones.

    ``sources``: source_id, parser_key, defaults struct, targets array.
    """
    c = F.col
    rows = sources.select("source_id", "parser_key", "defaults", F.explode("targets").alias("t"))
    out = rows.select(
        "source_id", "parser_key", c("t.logical_name").alias("logical_name"), c("t.url").alias("url"),
        F.coalesce("t.school_id", "defaults.school_id").alias("school_id"),
        F.coalesce("t.event_category", "defaults.event_category", F.lit("general")).alias("event_category"),
        F.coalesce("t.is_open_day", "defaults.is_open_day", F.lit(False)).alias("is_open_day"),
        F.coalesce("t.is_featured", "defaults.is_featured", F.lit(False)).alias("is_featured"),
        F.coalesce("t.priority_weight", "defaults.priority_weight", F.lit(0.0)).alias("priority_weight"),
        F.coalesce("t.placement_tags", "defaults.placement_tags", F.array().cast("array<string>")).alias("placement_tags"),
    )
    reason = F.coalesce(
        F.when(c("school_id").isNull(), F.lit("missing school_id")),
        F.when(non_blank("logical_name").isNull(), F.lit("logical_name must not be empty")),
        F.when(non_blank("url").isNull(), F.lit("URL must not be empty")),
    )
    marked = out.withColumn("reason", reason)
    return marked.where(c("reason").isNull()).drop("reason"), marked.where(c("reason").isNotNull())


def allowlist(urls: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    """Add ``allowed`` and ``reason``: scheme, domain or subdomain, no private host.

    A host is looked up by its own name and every parent domain, so the list
    is joined by equality and may be long.
    """
    c = F.col
    listed = domains.select(F.lower(F.ltrim(trimmed("domain"), F.lit("."))).alias("_suffix")).distinct()
    rows = urls.withColumns({"_scheme": F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), "_host": F.lower(F.try_parse_url(url, F.lit("HOST")))})
    labels = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.where(c("_host").isNotNull()).select("_host").distinct()
    matched = hosts.select("_host", F.explode(suffixes.alias("s")).alias("_suffix")).join(listed, "_suffix")
    known = matched.groupBy("_host").agg(F.bool_or(c("_suffix") == c("_host")).alias("_exact"))
    rows = rows.join(known, "_host", "left")
    private = c("_host").rlike(PRIVATE_HOST)
    reason = F.coalesce(
        F.when(c("_scheme").isNull(), F.lit("failed to parse target URL")),
        F.when(~c("_scheme").isin("http", "https"), F.concat(F.lit("unsupported URL scheme "), "_scheme")),
        F.when(c("_host").isNull(), F.lit("target URL must include a host name")),
        F.when(c("_exact").isNull(), F.concat(F.lit("host "), "_host", F.lit(" is outside the crawler allowlist"))),
        F.when(private & ~c("_exact"), F.concat(F.lit("host "), "_host", F.lit(" is private or local and must be explicitly allowed"))),
    )
    return rows.withColumns({"reason": reason, "allowed": reason.isNull()}).drop("_scheme", "_host", "_exact")


def parse_robots(files: DataFrame) -> DataFrame:
    """Rules of robots files: host, group, agents, allow, path.

    A group ends at an empty line, and at an agent line once its rules have
    begun.  Rows are lines of one small file each, so windows stay small.
    """
    c = F.col
    lines = files.select("host", F.posexplode(F.split("body", "\n")).alias("n", "raw"))
    text = trimmed(F.element_at(F.split("raw", "#"), 1))
    name, value = F.lower(trimmed(F.regexp_extract(text, r"^([^:]*):", 1))), trimmed(F.regexp_extract(text, r"^[^:]*:(.*)$", 1))
    lines = lines.select("host", "n", (text == "").alias("blank"), name.alias("name"), value.alias("value"))
    file_order = W.partitionBy("host").orderBy("n")
    lines = lines.withColumn("segment", F.sum(c("blank").cast("int")).over(file_order)).where(c("name").isin("user-agent", "allow", "disallow"))
    part = W.partitionBy("host", "segment").orderBy("n")
    agent = c("name") == "user-agent"
    lines = lines.withColumns(
        {"_agents": F.sum(agent.cast("int")).over(part), "_rules": F.sum((~agent).cast("int")).over(part)}
    )
    # rules seen up to the previous agent line of the segment; the first one counts from the start
    before = F.lag(F.when(agent, c("_rules")), 1).over(W.partitionBy("host", "segment", "name").orderBy("n"))
    base = F.when(c("_agents") <= 2, F.lit(0)).otherwise(before)
    closes = agent & (c("_agents") >= 2) & (c("_rules") > base)
    lines = lines.withColumn("_closes", truthy(closes))
    lines = lines.withColumn("group", F.sum(c("_closes").cast("int")).over(part))
    whole = W.partitionBy("host", "segment", "group")
    agents = F.collect_set(F.when(agent, ascii_lower("value"))).over(whole)
    lines = lines.withColumn("agents", agents)
    return lines.where(~agent).select("host", "segment", "group", F.array_sort("agents").alias("agents"), (c("name") == "allow").alias("allow"), c("value").alias("path"))


def robots_decision(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Allowed or not per (host, path, user_agent), with the rule that decided.

    The most specific agent wins, then the longest path; allow wins a tie.
    """
    c = F.col
    asked = urls.select("host", "path", "user_agent").distinct()
    wanted = ascii_lower("user_agent")
    fits = F.transform("agents", lambda a: F.when(a == "*", F.lit(0)).when(wanted.startswith(a), F.length(a)))
    joined = asked.join(rules.withColumnRenamed("path", "rule"), "host")
    joined = joined.withColumn("_fit", F.array_max(fits)).where(c("_fit").isNotNull())
    best = joined.groupBy("host", "user_agent").agg(F.max("_fit").alias("_fit"))
    path = F.when(c("path") == "", "/").otherwise(c("path"))
    hits = joined.join(best, ["host", "user_agent", "_fit"], "left_semi").where((c("rule") == "") | path.startswith(c("rule")))
    winner = hits.groupBy("host", "path", "user_agent").agg(
        F.max_by(F.struct("allow", "rule"), F.struct(F.length("rule"), "allow")).alias("w")
    )
    out = urls.join(winner, ["host", "path", "user_agent"], "left")
    rule = F.concat(F.when(c("w.allow"), "allow:").otherwise("disallow:"), "w.rule")
    return out.withColumns({"allowed": c("w").isNull() | c("w.allow") | (c("w.rule") == ""), "matched_rule": rule}).drop("w")


# --- fetch log ------------------------------------------------------------


def previous_value(df: DataFrame, keys: list[str], order: list[str], bucket: str, value: str, out: str) -> DataFrame:
    """The last non-null value before each row of its key.

    Done in two steps, inside time buckets and over one row per bucket, so
    that the rows of a very busy key are spread over tasks.
    """
    c = F.col
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ends = df.where(c(value).isNotNull()).groupBy(*keys, bucket).agg(F.max_by(value, F.struct(*order)).alias("_end"))
    # every bucket gets the end of the nearest earlier bucket that has one
    slots = null_safe_join(df.select(*keys, bucket).distinct(), ends, [*keys, bucket])
    across = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    carried = slots.withColumn("_carry", F.last_value("_end", ignoreNulls=True).over(across)).drop("_end")
    rows = df.withColumn("_inside", F.last_value(value, ignoreNulls=True).over(inside))
    return null_safe_join(rows, carried, [*keys, bucket]).withColumn(out, F.coalesce("_inside", "_carry")).drop("_inside", "_carry")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which null keys match one another."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(named, on, "left").drop(*[f"_right_{k}" for k in keys])


def content_changes(log: DataFrame) -> DataFrame:
    """Compare each checksum with the latest earlier one of the same target."""
    keys = ["manifest", "logical_name", "target_url"]
    days = log.withColumn("_day", F.to_date("fetched_at"))
    rows = previous_value(days, keys, ["fetched_at", "id"], "_day", "checksum_sha256", "previous_checksum").drop("_day")
    same = F.col("previous_checksum") == F.col("checksum_sha256")
    return rows.withColumns(
        {"content_changed": ~truthy(same), "content_status": F.when(truthy(same), "not_modified").otherwise("fetched")}
    )


def classify_fetch_errors(log: DataFrame, message: str = "error_message") -> DataFrame:
    blocked = F.lit(False)
    for marker in BLOCKED_MARKERS:
        blocked = blocked | F.contains(F.col(message), F.lit(marker))
    return log.withColumn("fetch_status", F.when(blocked, "blocked_policy").otherwise("fetch_failed"))


def latest_fetched(runs: DataFrame) -> DataFrame:
    """Newest fetched run of each manifest."""
    return runs.where(F.col("status") == "fetched").groupBy("manifest").agg(F.max("id").alias("crawl_run_id"))


# --- shape and extraction -------------------------------------------------


def _feed_verdict() -> tuple[Column, Column]:
    """Whether ``html`` is a JSON feed, and why."""
    v = F.try_parse_json("html")
    kind = F.schema_of_variant(v)
    rows = F.try_variant_get(v, "$", "array<variant>")

    def has(key: str) -> Column:
        return F.exists(rows, lambda r: F.try_variant_get(r, f"$.{key}", "variant").isNotNull())

    known = has(FEED_KEYS[0])
    for key in FEED_KEYS[1:]:
        known = known | has(key)
    problem = F.coalesce(
        F.when(v.isNull(), F.lit("failed to parse JSON feed")),
        F.when(~kind.startswith("ARRAY"), F.lit("expected a top-level JSON array")),
        F.when(F.size(rows) == 0, F.lit("expected a non-empty JSON array")),
        F.when(~truthy(known), F.lit("JSON feed is present but missing expected event keys (pageTitle/url/eventStartDate)")),
    )
    return problem.isNull(), F.coalesce(problem, F.concat(F.lit("matched JSON feed rows="), F.size(rows).cast("string")))


def _markup_verdict(shape: str, missing: Column) -> tuple[Column, Column]:
    """Whether none of a shape's labels is missing, and which are."""
    names = ", ".join(label for label, _ in HTML_SHAPES.get(shape) or SELECTOR_SHAPES[shape])
    text = F.when(F.size(missing) == 0, F.lit(f"matched selectors [{names}]")).otherwise(
        F.concat(F.lit("missing selectors ["), F.array_join(missing, ", "), F.lit("]"))
    )
    return F.size(missing) == 0, text


def check_page_shapes(pages: DataFrame) -> DataFrame:
    """Add ``matched`` and ``summary``: does a page look as the parser of its ``expected_shape`` expects?

    Shapes that take one tag are patterns; those with nested elements share one
    walk over the page's tags.  A null page lacks everything, an unknown or null
    shape is not matched.
    """
    shape, body = F.col("expected_shape"), F.coalesce("html", F.lit(""))
    walked = pages.withColumn("_missing", missing_labels(body, shape, SELECTOR_SHAPES))
    matched, summary = _feed_verdict()
    verdicts = {"json_feed": (matched, summary)}
    for name, labels in HTML_SHAPES.items():
        verdicts[name] = _markup_verdict(name, F.array_compact(F.array(*[F.when(~_visible(body).rlike(p), F.lit(label)) for label, p in labels])))
    for name in SELECTOR_SHAPES:
        verdicts[name] = _markup_verdict(name, F.col("_missing"))
    fits, text = F.lit(False), F.lit("unknown expected shape")
    for name, (matched, summary) in verdicts.items():
        fits, text = F.when(shape == name, matched).otherwise(fits), F.when(shape == name, summary).otherwise(text)
    note = F.coalesce(F.concat(F.lit(" content_type="), "content_type"), F.lit(""))
    return walked.withColumns({"matched": fits, "summary": F.concat(text, F.when(shape.isin(*verdicts), note).otherwise(F.lit("")))}).drop("_missing")


def check_shape(pages: DataFrame, shape: str) -> DataFrame:
    """As ``check_page_shapes``, with one shape for all pages."""
    note = F.coalesce(F.concat(F.lit(" content_type="), "content_type"), F.lit(""))
    if shape == "json_feed":
        matched, summary = _feed_verdict()
    elif shape in HTML_SHAPES:
        body = _visible(F.coalesce("html", F.lit("")))
        matched, summary = _markup_verdict(shape, F.array_compact(F.array(*[F.when(~body.rlike(p), F.lit(label)) for label, p in HTML_SHAPES[shape]])))
    else:
        matched, summary = _markup_verdict(shape, missing_labels(F.coalesce("html", F.lit("")), F.lit(shape), SELECTOR_SHAPES))
    return pages.withColumns({"matched": matched, "summary": F.concat(summary, note)})


@F.pandas_udf(T.StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def _visible(col) -> Column:
    """Markup without comments, scripts and styles."""
    return F.regexp_replace(col, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")


def extract_heading(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first heading of a page as one event; pages without one as failures."""
    body = pages.withColumn("_body", _visible("html"))
    raw = F.regexp_extract("_body", r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1)
    when = F.regexp_extract("_body", r"(?is)<time\b[^>]*\sdatetime\s*=\s*[\"']([^\"']*)[\"']", 1)
    rows = body.withColumns({"title": decode_entities(F.regexp_replace(raw, r"(?s)<[^>]*>", "")), "starts_at": non_blank(when)}).drop("_body")
    rows = rows.withColumn("title", clean_text("title"))
    found = F.coalesce(F.col("title"), F.lit("")) != ""
    events = _seeds(rows.where(found), title=F.col("title"), starts_at=F.col("starts_at"))
    failures = rows.where(~found).select("source_id", "logical_name", "target_url", F.lit("could not find <h1>").alias("message"))
    return events, failures


def _seeds(rows: DataFrame, **given: Column) -> DataFrame:
    kinds = {"seed_open_day": "boolean", "seed_featured": "boolean", "seed_weight": "double", "seed_tags": "array<string>"}
    cols = [given.get(n, F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in SEED]
    return rows.select("source_id", "logical_name", "target_url", *cols)


class _Cards(HTMLParser):
    """Collects the event cards of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict | None]] = []
        self.places: dict[str, list[int]] = {}  # where each tag is open
        self.inside: list[dict] = []  # the open cards
        self.reading: list[dict] = []  # cards whose title is open, the innermost last
        self.cards: list[dict] = []

    def handle_starttag(self, tag, attrs):
        attr = {k: v or "" for k, v in attrs}
        for card in self.inside:
            if tag in ("h2", "h3") and card["title"] is None:
                card["title"], card["depth"] = [], len(self.open)
                self.reading.append(card)
            if tag == "time" and "datetime" in attr and card["time"] is None:
                card["time"] = attr["datetime"]
            if "data-placement-tag" in attr:
                card["tags"].append(attr["data-placement-tag"])
        card = None
        if (tag == "article" and "data-crawl-event" in attr) or "crawl-event-card" in attr.get("class", "").split():
            card = {"attr": attr, "title": None, "depth": None, "time": None, "tags": []}
            self.cards.append(card)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append((tag, card))
            if card is not None:
                self.inside.append(card)

    def handle_endtag(self, tag):
        at = self.places[tag][-1] if self.places.get(tag) else len(self.open)
        while len(self.open) > at:
            closed, card = self.open.pop()
            self.places[closed].pop()
            if card is not None:
                self.inside.pop()
        while self.reading and len(self.open) <= self.reading[-1]["depth"]:
            self.reading.pop()

    def handle_data(self, data):
        for card in self.reading:
            card["title"].append(data)


CARD_ROWS = (
    "source_id string, logical_name string, target_url string, title string, starts_at string, school_id string, category string, "
    "open_day string, featured string, weight string, tags string, message string"
)


def extract_cards(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Event cards of listing pages; a page with a bad card fails as a whole.

    Only the markup walk is Python, in Arrow batches; values are typed and
    judged as columns.
    """

    def walk(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                parser = _Cards()
                parser.feed(row.html)
                parser.close()
                head = (row.source_id, row.logical_name, row.target_url)
                if not parser.cards:
                    out.append((*head, *[None] * 8, "did not find any event cards"))
                for card in parser.cards:
                    attr = card["attr"]
                    tags = attr.get("data-placement-tags")
                    if tags is None and card["tags"]:
                        tags = "|".join(t.strip() for t in card["tags"])
                    names = ("data-school-id", "data-category", "data-open-day", "data-featured", "data-priority-weight")
                    title = " ".join("".join(card["title"] or []).split())
                    out.append((*head, title, card["time"], *[attr.get(n) for n in names], tags, None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CARD_ROWS.split(", ")])

    from wayside.operators.normalize import PLACEMENTS, bool_text, tags

    c = F.col
    rows = pages.select("source_id", "logical_name", "target_url", "html").mapInPandas(walk, CARD_ROWS)
    typed = rows.withColumns({"_open": bool_text("open_day"), "_feat": bool_text("featured"), "_weight": trimmed("weight").try_cast("double"), "_tags": tags("tags")})
    allowed = F.array(*[F.lit(p) for p in PLACEMENTS])
    message = F.coalesce(
        c("message"),
        F.when(c("title") == "", F.lit("found a card without a title")),
        F.when((c("open_day").isNotNull() & c("_open").isNull()) | (c("featured").isNotNull() & c("_feat").isNull()), F.lit("unsupported boolean value")),
        F.when(c("weight").isNotNull() & c("_weight").isNull(), F.lit("failed to parse data-priority-weight")),
        F.when(F.size(F.array_except("_tags", allowed)) > 0, F.lit("unsupported placement tag")),
    )
    typed = typed.withColumn("message", message)
    page = ["source_id", "logical_name", "target_url"]
    failures = typed.where(c("message").isNotNull()).groupBy(*page).agg(F.min("message").alias("message"))
    sound = typed.where(c("message").isNull()).join(failures.select(*page), page, "left_anti")
    events = _seeds(
        sound, title=c("title"), starts_at=non_blank("starts_at"), seed_school_id=non_blank("school_id"), seed_category=non_blank("category"),
        seed_open_day=c("_open"), seed_featured=c("_feat"), seed_weight=c("_weight"), seed_tags=F.when(c("tags").isNotNull(), c("_tags")),
    )
    return events, failures


def extract_json_feed(pages: DataFrame, base_url: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON feeds (a page is one feed): all of them, or the newest ``limit`` per page; ``feed_drop_counts`` tells what that cuts."""
    c = F.col
    page = ["source_id", "logical_name", "target_url"]
    feed = pages.withColumn("f", F.from_json("html", f"array<{schemas.JSON_FEED_ROW}>"))
    broken = c("f").isNull() | ~truthy(F.schema_of_variant(F.try_parse_json("html")).startswith("ARRAY"))
    rows = feed.where(~broken).select(*page, F.explode("f").alias("r"))
    rows = rows.select(
        *page,
        non_blank("r.pageTitle").alias("title"),
        non_blank("r.url").alias("_url"),
        slash_date("r.eventStartDate").alias("starts_at"),
        slash_date("r.eventEndDate").alias("event_end_date"),
        *[non_blank(f"r.{n}").alias(a) for n, a in (("eventType", "event_type"), ("eventTarget", "event_target"), ("eventArea", "event_area"), ("eventApp", "event_app"), ("busho", "busho"))],
    )
    usable = rows.where(c("title").isNotNull() & c("_url").isNotNull()).withColumn("detail_url", absolute_url("_url", F.lit(base_url)))
    kept = usable
    if limit is not None:
        order = W.partitionBy(*page).orderBy(c("starts_at").desc_nulls_last(), "title", "detail_url")
        kept = usable.withColumn("rank", F.row_number().over(order)).where(c("rank") <= limit)
    details = F.to_json(F.struct(*FEED_DETAILS))
    events = _seeds(kept, title=c("title"), starts_at=c("starts_at"), detail_url=c("detail_url"), details=details)
    none = feed.where(~broken).join(usable.select(*page).distinct(), page, "left_anti").select(*page, F.lit("did not find any usable event rows").alias("message"))
    return events, feed.where(broken).select(*page, F.lit("failed to parse JSON feed").alias("message")).unionByName(none)


def feed_drop_counts(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Per feed page: input rows, rows without a title, rows without an address, rows kept and rows cut by ``limit``."""
    rows = pages.select("logical_name", "target_url", F.explode(F.from_json("html", f"array<{schemas.JSON_FEED_ROW}>")).alias("r"))
    no_title = non_blank("r.pageTitle").isNull()
    counts = rows.groupBy("logical_name", "target_url").agg(
        F.count(F.lit(1)).alias("input_rows"), F.count_if(no_title).alias("dropped_missing_title"),
        F.count_if(~no_title & non_blank("r.url").isNull()).alias("dropped_missing_url"),
    )
    usable = F.col("input_rows") - F.col("dropped_missing_title") - F.col("dropped_missing_url")
    kept = usable if limit is None else F.least(usable, F.lit(limit).cast("long"))
    return counts.withColumns({"kept_rows": kept, "cut_rows": usable - kept})


Extractor = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def extract_events(pages: DataFrame, parsers: dict[str, Extractor]) -> tuple[DataFrame, DataFrame]:
    """Route pages to extractors by ``parser_key``; unknown keys are failures."""
    events = failures = None
    for key, extractor in parsers.items():
        found, bad = extractor(pages.where(F.col("parser_key") == key))
        events = found if events is None else events.unionByName(found)
        failures = bad if failures is None else failures.unionByName(bad)
    unknown = pages.where(~F.coalesce(F.col("parser_key").isin(*parsers), F.lit(False)))
    lost = unknown.select("source_id", "logical_name", "target_url", F.lit("unknown parser_key").alias("message"))
    return events, failures.unionByName(lost)


# --- dates ----------------------------------------------------------------


def _iso(y: Column, m: Column, d: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", y, m, d)


def _japanese(text: Column) -> Column:
    """Full dates in running text; year and month carry over to later days."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9]+[^0-9])"), 1)
    marks = F.transform(found, lambda t: F.struct(F.regexp_extract(t, r"^([0-9]+)", 1).try_cast("int").alias("n"), F.right(t, F.lit(1)).alias("m")))
    zero = F.struct(F.lit(None).cast("int").alias("y"), F.lit(None).cast("int").alias("mo"), F.array().cast("array<string>").alias("out"))

    def step(s, x):
        year = (x["m"] == "年") & (x["n"] >= 2000)
        month = (x["m"] == "月") & x["n"].between(1, 12)
        day = (x["m"] == "日") & x["n"].between(1, 31) & s["y"].isNotNull() & s["mo"].isNotNull()
        return F.struct(
            F.when(year, x["n"]).otherwise(s["y"]).alias("y"),
            F.when(year, F.lit(None).cast("int")).when(month, x["n"]).otherwise(s["mo"]).alias("mo"),
            F.when(day, F.concat(s["out"], F.array(_iso(s["y"], s["mo"], x["n"])))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(marks, zero, step, lambda s: s["out"])


def _academic(text: Column, year: Column) -> Column:
    """`M/D` dates of an academic year that starts in April, each once."""
    found = F.regexp_extract_all(text, F.lit(r"(0*(?:1[0-2]|[1-9])/0*(?:3[01]|[12][0-9]|[1-9])(?![0-9]))"), 1)

    def one(t):
        month, day = (F.split(t, "/")[i].cast("int") for i in (0, 1))
        return _iso(year + F.when(month >= 4, 0).otherwise(1), month, day)

    return F.array_distinct(F.transform(found, one))


def _url(url: Column) -> Column:
    """The first eight digits of a path that form a date from 2000 to 2100."""
    runs = F.regexp_extract_all(F.try_parse_url(url, F.lit("PATH")), F.lit(r"([0-9]{8})[0-9]*"), 1)

    def fits(t):
        y, m, d = (F.substring(t, a, n).cast("int") for a, n in ((1, 4), (5, 2), (7, 2)))
        return y.between(2000, 2100) & m.between(1, 12) & d.between(1, 31)

    good = F.filter(runs, fits)
    return F.transform(F.slice(good, 1, 1), lambda t: F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)))


def extract_dates(rows: DataFrame, kind: str, text: str = "text", year: str = "academic_year") -> DataFrame:
    """One row per date found: ``japanese``, ``academic`` or ``url``."""
    if kind == "japanese":
        dates = _japanese(F.col(text))
    elif kind == "academic":
        dates = _academic(F.col(text), F.col(year))
    elif kind == "url":
        dates = _url(F.col(text))
    else:
        raise ValueError(f"unknown date kind: {kind}")
    return rows.select("*", F.posexplode(dates).alias("date_pos", "date"))


def infer_years(rows: DataFrame) -> DataFrame:
    """Dates of ordered monthly rows of a page.

    ``rows``: page, pos, month, day, detail_url_date.  A dated address gives
    the year; otherwise the year carries on and grows by one when the month
    goes down.  The first dated address of the page starts the count.
    """
    c = F.col
    page = W.partitionBy("page").orderBy("pos")
    url_year = F.substring("detail_url_date", 1, 4).try_cast("int")
    start = F.first(url_year, ignorenulls=True).over(W.partitionBy("page").orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    out = rows.withColumns({"_y": url_year, "_start": start, "_drop": truthy(c("month") < F.lag("month").over(page)) & c("detail_url_date").isNull()})
    out = out.withColumn("_run", F.count("_y").over(page))
    # drops since the last dated address, on top of its year
    since = F.sum(c("_drop").cast("int")).over(W.partitionBy("page", "_run").orderBy("pos"))
    base = F.coalesce(F.last("_y", ignorenulls=True).over(page), "_start")
    out = out.withColumns({"_year": base + since})
    date = F.when(c("detail_url_date").isNotNull(), c("detail_url_date")).otherwise(_iso(c("_year"), c("month"), c("day")))
    return out.withColumn("starts_at", F.when(c("_year").isNotNull(), date)).drop("_y", "_start", "_drop", "_run", "_year")


def date_drift(events: DataFrame) -> DataFrame:
    """Events whose month label is not the month of the dated address."""
    label = F.regexp_extract("month_label", "([0-9]+)", 1).try_cast("int")
    dated = F.substring("detail_url_date", 6, 2).try_cast("int")
    text = F.concat("logical_name", F.lit(" title="), "title", F.lit(" month_label="), "month_label", F.lit(" detail_url_date="), "detail_url_date")
    return events.where(label != dated).withColumn("warning", text)


# --- events ---------------------------------------------------------------


def event_id(source: Column, school: Column, title: Column, starts_at: Column) -> Column:
    """`crawl_<source>_` and 16 hex digits over source, school, title and time."""
    key = ascii_lower(F.btrim(F.regexp_replace(title, r"(?U)\s+", " "), F.lit(WHITE_SPACE)))
    nul = F.char(F.lit(0))
    digest = F.sha2(F.concat(source, nul, school, nul, key, nul, F.coalesce(starts_at, F.lit(""))).cast("binary"), 256)
    flat = F.regexp_replace(ascii_lower(source), "[^0-9a-z]", "_")
    return F.concat(F.lit("crawl_"), flat, F.lit("_"), F.left(digest, F.lit(16)))


def rejected_seeds(seeds: DataFrame, targets: DataFrame) -> DataFrame:
    """The seeds that ``finalize_events`` leaves out, with the reason: as failures of their page."""
    known = targets.select("source_id", "logical_name").distinct().withColumn("_known", F.lit(True))
    reason = F.when(F.col("_known").isNull(), F.lit("unknown target")).when(F.coalesce(trimmed("title"), F.lit("")) == "", F.lit("blank title"))
    rows = seeds.join(known, ["source_id", "logical_name"], "left").withColumn("message", reason)
    return rows.where(F.col("message").isNotNull()).select("source_id", "logical_name", "target_url", "message")


def finalize_events(seeds: DataFrame, targets: DataFrame) -> DataFrame:
    """Seeds with the defaults of their target, their details and a stable event id; ``rejected_seeds`` has the others."""
    c = F.col
    t = targets.select(
        "source_id", "logical_name", *[c(n).alias(f"_{n}") for n in ("school_id", "event_category", "is_open_day", "is_featured", "priority_weight", "placement_tags")]
    )
    rows = seeds.join(t, ["source_id", "logical_name"]).withColumns(
        {"title": trimmed("title"), "starts_at": non_blank("starts_at"), "school_id": F.coalesce("seed_school_id", "_school_id")}
    )
    return rows.where(c("title") != "").select(
        event_id(c("source_id"), c("school_id"), c("title"), c("starts_at")).alias("event_id"), "source_id", "school_id", "title",
        F.coalesce("seed_category", "_event_category").alias("event_category"), F.coalesce("seed_open_day", "_is_open_day").alias("is_open_day"),
        F.coalesce("seed_featured", "_is_featured").alias("is_featured"), F.coalesce("seed_weight", "_priority_weight").alias("priority_weight"),
        "starts_at", F.coalesce("seed_tags", "_placement_tags").alias("placement_tags"), "logical_name", "target_url", "detail_url",
        F.coalesce("details", F.lit("{}")).alias("details"),
    )


def dedupe_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep the first event per id by (name, address, title); report the rest.

    The kept row is a partial aggregate, so an id with very many copies never
    meets in one task; the report joins it back.
    """
    rank = ["logical_name", "target_url", "title"]
    first = df.groupBy("event_id").agg(F.min(F.struct(*rank)).alias("k"), F.count(F.lit(1)).alias("_n"))
    kept = df.groupBy("event_id").agg(F.min_by(F.struct(*df.columns), F.struct(*rank)).alias("r")).select("r.*")
    repeated = first.where("_n > 1").select("event_id", F.col("k.logical_name").alias("kept_logical_name"), F.col("k.target_url").alias("kept_target_url"), F.col("_n"))
    copies = df.groupBy("event_id", "logical_name", "target_url").agg(F.count(F.lit(1)).alias("copies"))
    report = copies.join(repeated, "event_id").withColumn(
        "copies",
        F.col("copies")
        - F.when((F.col("logical_name") == F.col("kept_logical_name")) & (F.col("target_url") == F.col("kept_target_url")), 1).otherwise(0),
    )
    report = report.where("copies > 0").select(
        F.col("event_id").alias("dedupe_key"), F.lit("duplicate_event_id").alias("reason"), "kept_logical_name", "kept_target_url",
        F.col("logical_name").alias("dropped_logical_name"), F.col("target_url").alias("dropped_target_url"), F.col("copies").alias("dropped_rows"),
    )
    return kept, report


def parse_reports(events: DataFrame, failures: DataFrame) -> DataFrame:
    """One report row per page: extracted, zero rows (warn) or failed (error)."""
    zero = F.lit(False)
    for marker in ZERO_EVENT_MARKERS:
        zero = zero | F.contains(F.col("message"), F.lit(marker))
    ok = events.groupBy("logical_name", "target_url").agg(F.count(F.lit(1)).alias("parsed_rows")).select(
        "logical_name", "target_url", F.lit("info").alias("level"), F.lit("events_extracted").alias("code"), F.lit(None).cast("string").alias("message"), "parsed_rows"
    )
    bad = failures.select(
        "logical_name", "target_url", F.when(zero, "warn").otherwise("error").alias("level"), F.when(zero, "parsed_zero_rows").otherwise("parse_failed").alias("code"),
        "message", F.when(zero, F.lit(0)).cast("long").alias("parsed_rows"),
    )
    return ok.unionByName(bad)


def can_deactivate(log: DataFrame, reports: DataFrame) -> DataFrame:
    """Per run: may rows that were not seen be switched off?"""
    fetched = log.groupBy("crawl_run_id").agg(F.bool_and(F.col("fetch_status").isin("fetched", "not_modified")).alias("_all"))
    bad = reports.groupBy("crawl_run_id").agg(F.bool_or(F.col("code").isin("parse_failed", "parsed_zero_rows")).alias("_bad"))
    return fetched.join(bad, "crawl_run_id", "left").select("crawl_run_id", (F.col("_all") & ~F.coalesce("_bad", F.lit(False))).alias("can_deactivate"))


def import_events(
    events: DataFrame, new: DataFrame, schools: DataFrame, source_type: str, source_key: str, deactivate: bool, updated_at: Column
) -> tuple[DataFrame, DataFrame]:
    """Upsert a feed into the events table and switch off what it left out.

    ``new`` has the event columns (id, school_id, ...).  Rows of unknown
    schools are skipped; then, and for partial imports, nothing is switched
    off.  Returns the new events table and the report rows.
    """
    c = F.col
    known = schools.select(c("id").alias("school_id"))
    fresh = new.join(known, "school_id", "left_semi").withColumns(
        {"is_active": F.lit(True), "source_type": F.lit(source_type), "source_key": F.lit(source_key), "updated_at": updated_at}
    )
    missing = new.join(known, "school_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    allowed = F.lit(deactivate) & (missing.scalar() == 0)
    mine = (c("source_type") == source_type) & (c("source_key") == source_key) & c("is_active")
    seen = fresh.select("id", F.lit(True).alias("_seen")).dropDuplicates(["id"])
    marked = events.join(seen, "id", "left").withColumn("_off", truthy(mine & c("_seen").isNull() & allowed))
    stored = marked.withColumns(
        {"is_active": c("is_active") & ~c("_off"), "updated_at": F.when(c("_off"), updated_at).otherwise(c("updated_at"))}
    )
    table = upsert(stored.drop("_seen", "_off"), fresh.select(*events.columns), ["id"])

    def report(level: str, code: str, rows: DataFrame, when: Column) -> DataFrame:
        return rows.where(when).select(F.lit(level).alias("level"), F.lit(f"{source_type}_{code}").alias("code"), c("n").alias("row_count"))

    done = fresh.agg(F.count(F.lit(1)).alias("n"))
    off = marked.agg(F.count_if("_off").alias("n"))
    none = missing.select(F.lit(None).cast("long").alias("n"))
    reports = (
        report("info", "imported", done, F.lit(True))
        .unionByName(report("warn", "missing_school", missing, c("n") > 0))
        .unionByName(report("warn", "skipped_stale_deactivation", none, F.lit(not deactivate)))
        .unionByName(report("warn", "skipped_missing_school_deactivation", missing, F.lit(deactivate) & (c("n") > 0)))
        .unionByName(report("info", "deactivated_stale_rows", off, c("n") > 0))
    )
    return table, reports


def import_impact(events: DataFrame, parsed: DataFrame, schools: DataFrame, source_key: str, can_switch_off: bool) -> DataFrame:
    """What an import would do, without doing it (one row)."""
    c = F.col
    kept, _ = dedupe_events(parsed)
    known = schools.select(c("id").alias("school_id"), F.lit(True).alias("_known"))
    judged = kept.join(known, "school_id", "left")
    counts = judged.agg(
        F.count(F.lit(1)).alias("deduped_rows"), F.count_if(c("_known")).alias("imported_rows"), F.count_if(c("_known").isNull()).alias("missing_school_rows")
    )
    active = events.where((c("source_type") == "crawl") & (c("source_key") == source_key) & c("is_active")).select(c("id").alias("event_id"))
    gone = active.join(judged.where("_known").select("event_id"), "event_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
    total = parsed.agg(F.count(F.lit(1)).alias("n")).scalar()
    off = F.when(F.lit(can_switch_off) & (c("missing_school_rows") == 0), gone).otherwise(F.lit(0).cast("long"))
    warnings = F.array_compact(
        F.array(
            F.when(total == 0, F.lit("parsed_zero_rows")),
            F.when(c("missing_school_rows") > 0, F.lit("missing_school_id")),
            F.when(F.lit(not can_switch_off), F.lit("partial_import_skips_stale_deactivation")).when(
                c("missing_school_rows") > 0, F.lit("missing_school_skips_stale_deactivation")
            ),
        )
    )
    return counts.select(total.alias("parsed_rows"), "*", off.alias("deactivated_rows"), warnings.alias("warnings"))
