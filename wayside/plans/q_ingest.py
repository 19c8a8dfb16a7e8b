"""Queries over feeds, normalisers, dimensions and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayside.operators import dims, normalize
from wayside.plans.registry import extra_tables, query
from wayside.plans.testmap import as_of
from wayside.sources import audit, feeds, sinks

_C = F.col


def _s(key):
    return _C(key).cast("string")


def raw_feed(m):
    """Event feed text made of parts, with every kind of flaw in it."""
    k = _C("p_partkey")
    return m.source("part").select(
        F.when(k % 50 == 1, F.lit(" ")).when(k % 31 == 2, F.lit("e7")).otherwise(F.concat(F.lit("e"), _s("p_partkey"))).alias("event_id"),
        F.when(k % 41 == 3, F.lit("")).otherwise(F.concat(F.lit("s"), (k % 500).cast("string"))).alias("school_id"),
        F.when(k % 43 == 4, F.lit("　")).otherwise(_C("p_name")).alias("title"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.lower("p_type")).alias("event_category"),
        F.when(k % 2 == 0, F.lit("true")).when(k % 47 == 5, F.lit("maybe")).otherwise(F.lit("")).alias("is_open_day"),
        F.lit("false").alias("is_featured"),
        F.when(k % 3 == 0, F.lit("")).otherwise((k % 10).cast("string")).alias("priority_weight"),
        F.when(k % 7 == 0, F.lit("2024-02-03")).when(k % 7 == 1, F.lit("2024-02-03T09:30:00+09:00")).when(k % 7 == 2, F.lit("2024-02-03T09:30:00Z"))
        .when(k % 53 == 6, F.lit("03/02/2024")).otherwise(F.lit(" ")).alias("starts_at"),
        F.when(k % 37 == 7, F.lit("home|shop")).when(k % 3 == 1, F.lit("home| search ||")).otherwise(F.lit("")).alias("placement_tags"),
        F.when(k % 59 == 8, F.lit("[1]")).when(k % 4 == 0, F.lit('{"a":1}')).alias("details"),
    )


extra_tables(
    x_feed="""SELECT p_partkey AS k, CASE WHEN p_partkey % 50 = 1 THEN ' ' WHEN p_partkey % 31 = 2 THEN 'e7' ELSE 'e' || p_partkey END AS event_id,
            CASE WHEN p_partkey % 41 = 3 THEN '' ELSE 's' || (p_partkey % 500) END AS school_id, CASE WHEN p_partkey % 43 = 4 THEN '' ELSE p_name END AS title,
            CASE WHEN p_partkey % 5 = 0 THEN 'general' ELSE lower(p_type) END AS event_category,
            CASE WHEN p_partkey % 2 = 0 THEN true WHEN p_partkey % 47 = 5 THEN NULL ELSE false END AS is_open_day,
            CASE WHEN p_partkey % 3 = 0 THEN 0.0e0 ELSE CAST(p_partkey % 10 AS DOUBLE) END AS priority_weight,
            CASE WHEN p_partkey % 7 = 0 THEN TIMESTAMP '2024-02-03 00:00:00' WHEN p_partkey % 7 = 1 THEN TIMESTAMP '2024-02-03 00:30:00'
                WHEN p_partkey % 7 = 2 THEN TIMESTAMP '2024-02-03 09:30:00' END AS starts_at,
            p_partkey % 7 NOT IN (0, 1, 2) AND p_partkey % 53 = 6 AS bad_time,
            p_partkey % 37 = 7 AS bad_tags, CASE WHEN p_partkey % 37 <> 7 AND p_partkey % 3 = 1 THEN 'home,search' ELSE '' END AS tags,
            p_partkey % 59 = 8 AS bad_details FROM part""",
    x_feed_checked="""SELECT *, CASE WHEN trim(event_id) = '' THEN 'event_id must not be empty' WHEN school_id = '' THEN 'school_id must not be empty' WHEN title = '' THEN 'title must not be empty'
            WHEN count(*) OVER (PARTITION BY event_id) > 1 THEN 'duplicate event_id' WHEN bad_time THEN 'starts_at must be a date or an RFC3339 time' WHEN bad_tags THEN 'unsupported placement tag'
            WHEN is_open_day IS NULL THEN 'a value could not be read' WHEN bad_details THEN 'details must be a JSON object' END AS reason FROM x_feed""",
)


def _validated(m):
    return normalize.validate_events(feeds.event_defaults(raw_feed(m)))


query(
    "validate_events",
    "SELECT coalesce(reason, 'ok') AS verdict, count(*) AS records, min(event_id) AS first_id FROM x_feed_checked GROUP BY 1",
)(
    lambda m: _validated(m)[0].withColumn("reason", F.lit("ok")).unionByName(_validated(m)[1]).groupBy(_C("reason").alias("verdict"))
    .agg(F.count(F.lit(1)).alias("records"), F.min("event_id").alias("first_id"))
)
query(
    "feed_to_events",
    "SELECT event_id AS id, school_id, title, event_category, is_open_day, priority_weight, starts_at, tags FROM x_feed_checked WHERE reason IS NULL",
)(
    lambda m: normalize.to_events(_validated(m)[0], F.lit("event_csv"), F.lit("feed")).select(
        "id", "school_id", "title", "event_category", "is_open_day", "priority_weight", "starts_at", F.array_join("placement_tags", ",").alias("tags")
    )
)


def json_lines(m):
    """The feed as JSON lines; tags as a list in half of them, some blank lines."""
    k = _C("p_partkey")
    rows = m.source("part").select(
        k,
        F.to_json(F.struct(F.concat(F.lit("e"), _s("p_partkey")).alias("event_id"), F.lit("s1").alias("school_id"), _C("p_name").alias("title"), (k % 2 == 0).alias("is_open_day"))).alias("head"),
    )
    tags = F.when(k % 2 == 0, F.lit(',"placement_tags":["home","detail"]')).otherwise(F.lit(',"placement_tags":"mypage|home","priority_weight":1.5'))
    return rows.select(F.when(k % 10 == 9, F.lit("  ")).otherwise(F.concat(F.expr("substring(head, 1, length(head) - 1)"), tags, F.lit(',"details":{"n":1}}'))).alias("value"))


query(
    "events_ndjson",
    """SELECT 'e' || p_partkey AS event_id, p_name AS title, 'general' AS event_category, p_partkey % 2 = 0 AS is_open_day, CASE WHEN p_partkey % 2 = 0 THEN 0.0e0 ELSE 1.5e0 END AS priority_weight,
        CASE WHEN p_partkey % 2 = 0 THEN 'home|detail' ELSE 'mypage|home' END AS placement_tags, '{"n":1}' AS details FROM part WHERE p_partkey % 10 <> 9""",
)(
    lambda m: feeds.parse_events_ndjson(json_lines(m)).select(
        "event_id", "title", "event_category", "is_open_day", "priority_weight", "placement_tags", "details"
    )
)
query(
    "normalize_times",
    "SELECT starts_at, bad_time AS rejected, count(*) AS records FROM x_feed GROUP BY 1, 2",
)(
    lambda m: (lambda ok, bad: ok.select("starts_at", F.lit(False).alias("rejected")).unionByName(
        bad.select(F.lit(None).cast("timestamp_ntz").alias("starts_at"), F.lit(True).alias("rejected"))
    ))(*normalize.normalize_times(raw_feed(m), "starts_at")).groupBy("starts_at", "rejected").agg(F.count(F.lit(1)).alias("records"))
)
query(
    "backfill_legacy_times",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate - INTERVAL 9 HOUR WHEN 2 THEN TIMESTAMP '1970-01-01 00:00:00' ELSE o_orderdate END AS at FROM orders""",
)(
    lambda m: normalize.backfill_legacy_times(
        m.source("orders").select(
            "o_orderkey",
            F.when(_C("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(
                _C("o_orderkey") % 4 == 1, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))
            ).when(_C("o_orderkey") % 4 == 2, F.lit("next week")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("at"),
        ),
        "at",
    )
)
query(
    "stable_ids",
    """SELECT p_partkey, CASE WHEN s = '' THEN 'item_unknown' ELSE 'item_' || s END AS id FROM (
        SELECT p_partkey, trim(regexp_replace(lower(p_brand || ':' || p_name), '[^0-9a-z]+', '_', 'g'), '_') AS s FROM part)""",
)(lambda m: normalize.with_stable_id(m.source("part"), "item", ["p_brand", "p_name"]).select("p_partkey", "id"))


def track_rows(m):
    """Log rows as they arrive, with flaws by id."""
    k = _C("id")
    return m.user_events.select(
        "id",
        F.when(k % 29 == 0, F.lit("")).otherwise(_C("user_id")).alias("user_id"),
        F.when(k % 23 == 1, F.lit(None)).otherwise(_C("school_id")).alias("school_id"),
        F.when(k % 31 == 2, F.lit("page_view")).otherwise(_C("event_type")).alias("event_kind"),
        "event_id",
        F.when(k % 19 == 3, F.lit(" ")).otherwise(_C("target_station_id")).alias("target_station_id"),
        F.when(k % 17 == 4, F.lit("yesterday")).when(k % 2 == 0, F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("occurred_at"),
        "payload",
    )


extra_tables(
    x_track="""SELECT id, CASE WHEN id % 29 = 0 THEN '' ELSE user_id END AS user_id, CASE WHEN id % 23 = 1 THEN NULL ELSE school_id END AS school_id,
            CASE WHEN id % 31 = 2 THEN 'page_view' ELSE event_type END AS event_kind, event_id,
            CASE WHEN id % 19 = 3 THEN '' ELSE target_station_id END AS target_station_id, id % 17 = 4 AS bad_time,
            CASE WHEN id % 2 = 0 THEN date_trunc('second', occurred_at) ELSE TIMESTAMP '2024-01-31 00:00:00' END AS occurred_at FROM m_user_events""",
    x_track_checked="""SELECT *, CASE WHEN user_id = '' THEN 'user_id must not be empty' WHEN event_kind = 'page_view' THEN 'unknown event_kind'
            WHEN event_kind IN ('school_view', 'school_save', 'apply_click', 'share') AND school_id IS NULL THEN 'school_id is required for ' || event_kind
            WHEN event_kind = 'search_execute' AND coalesce(target_station_id, '') = '' THEN 'target_station_id is required for search_execute'
            WHEN event_kind = 'event_view' AND event_id IS NULL AND school_id IS NULL THEN 'event_view requires event_id or school_id'
            WHEN bad_time THEN 'occurred_at must be RFC3339' END AS reason FROM x_track""",
)


@query(
    "validate_track",
    """SELECT coalesce(reason, 'ok') AS verdict, count(*) AS records, max(CASE WHEN reason IS NULL THEN occurred_at END) AS newest FROM x_track_checked GROUP BY 1""",
)
def _validate_track(m):
    ok, bad = normalize.validate_track(track_rows(m), as_of())
    rows = ok.select(F.lit("ok").alias("verdict"), "occurred_at").unionByName(
        bad.select(_C("reason").alias("verdict"), F.lit(None).cast("timestamp_ntz").alias("occurred_at"))
    )
    return rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("records"), F.max("occurred_at").alias("newest"))


@query(
    "resolve_event_school",
    """SELECT l.id, CASE WHEN l.event_id IS NOT NULL AND e.id IS NULL THEN 'unknown event_id' WHEN e.school_id <> l.school_id THEN 'event belongs to another school' END AS reason,
        coalesce(l.school_id, CASE WHEN e.id IS NOT NULL THEN e.school_id END) AS school_id
       FROM (SELECT id, CASE WHEN id % 3 <> 0 THEN NULL ELSE school_id END AS school_id, CASE WHEN id % 7 = 1 THEN 'no' || id ELSE event_id END AS event_id FROM m_user_events) l
       LEFT JOIN m_events e ON e.id = l.event_id""",
)
def _resolve_school(m):
    unknown = F.when(_C("id") % 7 == 1, F.concat(F.lit("no"), _C("id").cast("string"))).otherwise(_C("event_id"))
    log = m.user_events.withColumns({"school_id": F.when(_C("id") % 3 == 0, _C("school_id")), "event_id": unknown})
    ok, bad = normalize.resolve_event_school(log, m.events)
    none = F.lit(None).cast("string")
    return ok.select("id", none.alias("reason"), "school_id").unionByName(bad.select("id", "reason", "school_id"))


@query(
    "check_refs",
    """SELECT id, CASE WHEN school_id IS NOT NULL AND school_id NOT IN (SELECT id FROM m_schools) THEN 'unknown school_id'
        WHEN event_id IS NOT NULL AND event_id NOT IN (SELECT id FROM m_events) THEN 'unknown event_id'
        WHEN target_station_id IS NOT NULL AND target_station_id NOT IN (SELECT id FROM m_stations) THEN 'unknown target_station_id' END AS reason
       FROM (SELECT id, CASE WHEN id % 11 = 1 THEN 'no' || id ELSE school_id END AS school_id, CASE WHEN id % 11 = 2 THEN 'no' || id ELSE event_id END AS event_id,
             CASE WHEN id % 11 = 3 THEN 'no' || id ELSE target_station_id END AS target_station_id FROM m_user_events)""",
)
def _check_refs(m):
    none = F.concat(F.lit("no"), _C("id").cast("string"))
    altered = {n: F.when(_C("id") % 11 == k, none).otherwise(_C(n)) for k, n in ((1, "school_id"), (2, "event_id"), (3, "target_station_id"))}
    ok, bad = normalize.check_refs(m.user_events.withColumns(altered), m.schools, m.events, m.stations)
    return ok.select("id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("id", "reason"))


query("hash_users", "SELECT id, sha256('pepper' || chr(0) || user_id) AS user_id_hash FROM m_user_events")(
    lambda m: normalize.hash_users(m.user_events.select("id", "user_id"), "pepper")
)
query(
    "to_entity",
    """SELECT id, name AS display_name, area AS a, prefecture_name AS p, school_type AS t, group_id AS g FROM m_schools""",
)(
    lambda m: normalize.to_entity(m.schools).select(
        "id", "display_name", *[F.element_at("attributes", k).alias(n) for n, k in (("a", "area"), ("p", "prefecture_name"), ("t", "school_type"), ("g", "group_id"))]
    )
)
query(
    "to_occurrence",
    "SELECT id, school_id AS entity_id, event_category AS occurrence_kind, starts_at, CASE WHEN id LIKE '%5' THEN 4 ELSE 5 END AS attributes, is_active FROM m_events",
)(
    lambda m: normalize.to_occurrence(m.events.withColumn("details", F.when(_C("id").endswith("5"), F.lit("{ }")).otherwise(_C("details")))).select(
        "id", "entity_id", "occurrence_kind", "starts_at", F.size(F.map_keys("attributes")).alias("attributes"), "is_active"
    )
)
query(
    "to_canonical",
    """SELECT 'entity' AS record_kind, id AS entity_id, id AS record_id, name AS title, CAST(NULL AS VARCHAR) AS station_id FROM m_schools
       UNION ALL SELECT 'occurrence', school_id, id, title, NULL FROM m_events
       UNION ALL SELECT 'context_evidence', school_id, school_id || ':' || station_id, NULL, station_id FROM m_links""",
)(
    lambda m: normalize.to_canonical(
        normalize.to_entity(m.schools),
        normalize.to_occurrence(m.events),
        m.links.select(
            F.concat_ws(":", "school_id", "station_id").alias("record_id"), _C("school_id").alias("entity_id"), "station_id", F.lit(None).cast("string").alias("line_id"), "line_name"
        ),
        "profile",
        "source",
    ).select("record_kind", "entity_id", "record_id", "title", _C("location_context.station_id").alias("station_id"))
)


@query(
    "clean_extracted",
    """SELECT p_partkey, CASE WHEN p_partkey % 11 = 5 THEN 'unsupported is_open_day value' END AS reason,
        CASE WHEN p_partkey % 11 = 5 THEN NULL ELSE p_name END AS title,
        CASE WHEN p_partkey % 11 <> 5 AND p_partkey % 3 = 0 THEN '2024-0' || (p_partkey % 9 + 1) || '-07' END AS starts_at,
        CASE WHEN p_partkey % 11 = 5 THEN NULL WHEN p_partkey % 2 = 0 THEN 'https://site.example/news/' || p_partkey ELSE 'http://other.example/' || p_partkey END AS detail_url,
        CASE WHEN p_partkey % 11 = 5 THEN NULL ELSE p_partkey % 11 < 5 END AS is_open_day FROM part""",
)
def _clean(m):
    k = _C("p_partkey")
    raw = m.source("part").select(
        "p_partkey",
        F.concat(F.lit("　 "), F.regexp_replace("p_name", " ", " \n "), F.lit("\t")).alias("title"),
        F.when(k % 3 == 0, F.concat(F.lit(" 2024/"), (k % 9 + 1).cast("string"), F.lit("/7"))).when(k % 3 == 1, F.lit("2024/1")).otherwise(F.lit("1/2/3/4")).alias("starts_at"),
        F.when(k % 2 == 0, F.concat(F.lit("/news/"), _s("p_partkey"))).otherwise(F.concat(F.lit("http://other.example/"), _s("p_partkey"))).alias("detail_url"),
        F.when(k % 11 == 5, F.lit("perhaps")).when(k % 11 < 5, F.lit("YES")).otherwise(F.lit(" 0 ")).alias("is_open_day"),
    )
    ok, bad = normalize.clean_extracted(raw, "https://site.example/")
    none = F.lit(None)
    cols = ["p_partkey", "title", "starts_at", "detail_url", "is_open_day"]
    return ok.select(*cols, none.cast("string").alias("reason")).unionByName(
        bad.select("p_partkey", "reason", *[none.cast("string").alias(n) for n in cols[1:4]], none.cast("boolean").alias("is_open_day"))
    )


# dimensions
query(
    "build_lines",
    "SELECT 'line_' || lower(c_mktsegment) AS line_id, c_mktsegment AS line_name, count(*) AS stations FROM customer GROUP BY 1, 2",
)(
    lambda m: (lambda lines, st: lines.join(st.groupBy("line_id").agg(F.count(F.lit(1)).alias("stations")), "line_id"))(
        *dims.build_lines(m.stations.drop("line_id"))
    ).select("line_id", "line_name", "stations")
)
query(
    "build_areas",
    """SELECT DISTINCT 'area_' || trim(regexp_replace(lower(prefecture_name), '[^0-9a-z]+', '_', 'g'), '_') AS area_id, prefecture_name, CAST(NULL AS VARCHAR) AS city_name, 'prefecture' AS area_level FROM m_schools WHERE prefecture_name IS NOT NULL
       UNION SELECT 'area_' || trim(regexp_replace(lower(coalesce(prefecture_name || ':', '') || area), '[^0-9a-z]+', '_', 'g'), '_'), prefecture_name, area, 'city' FROM m_schools""",
)(lambda m: dims.build_areas(m.schools).select("area_id", "prefecture_name", "city_name", "area_level"))


def _codes(m):
    k = _C("s_suppkey")
    return m.source("supplier").select(
        F.concat(F.lit("s"), (k + 50).cast("string")).alias("school_id"), F.concat(F.lit("New "), "s_name").alias("name"), F.lit("Town").alias("city_name"),
        F.lit("North").alias("prefecture_name"), F.lit("high").alias("school_type"),
    )


query(
    "merge_schools",
    """SELECT coalesce(c.id, n.id) AS id, coalesce(n.name, c.name) AS name, CASE WHEN n.id IS NOT NULL THEN 'Town' ELSE c.area END AS area,
        CASE WHEN n.id IS NOT NULL THEN coalesce(nullif(c.group_id, ''), n.id) ELSE c.group_id END AS group_id
       FROM (SELECT id, name, area, CASE WHEN id LIKE '%3' THEN '' ELSE group_id END AS group_id FROM m_schools) c
       FULL JOIN (SELECT 's' || (s_suppkey + 50) AS id, 'New ' || s_name AS name FROM supplier) n ON n.id = c.id""",
)(
    lambda m: dims.merge_schools(m.schools.withColumn("group_id", F.when(_C("id").endswith("3"), F.lit("")).otherwise(_C("group_id"))), _codes(m)).select(
        "id", "name", "area", "group_id"
    )
)
query(
    "merge_stations",
    """SELECT coalesce(c.id, n.id) AS id, coalesce(n.name, c.name) AS name, coalesce(n.line, c.line_name) AS line_name, c.line_id
       FROM m_stations c FULL JOIN (SELECT 'c' || (c_custkey * 2) AS id, 'rail' || c_custkey AS name, 'Rail' AS line FROM customer) n ON n.id = c.id""",
)(
    lambda m: dims.merge_stations(
        m.stations,
        m.source("customer").select(
            F.concat(F.lit("c"), (_C("c_custkey") * 2).cast("string")).alias("station_id"), F.concat(F.lit("rail"), _s("c_custkey")).alias("station_name"),
            F.lit("Rail").alias("line_name"), F.lit(35.0).alias("latitude"), F.lit(139.0).alias("longitude"),
        ),
    ).select("id", "name", "line_name", "line_id")
)


def _postal(m, shift):
    k = _C("c_custkey") + shift
    return m.source("customer").select(
        F.lpad(k.cast("string"), 7, "0").alias("postal_code"), F.lit("P").alias("prefecture_name"), _C("c_mktsegment").alias("city_name"), F.lit("T").alias("town_name")
    )


query(
    "merge_postal",
    """SELECT lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS postal_code, 'P' AS prefecture_name, c_mktsegment AS city_name, 'T' AS town_name FROM customer
       UNION SELECT lpad(CAST(c_custkey + 500 AS VARCHAR), 7, '0'), 'P', c_mktsegment, 'T' FROM customer""",
)(lambda m: dims.merge_postal(_postal(m, 0), _postal(m, 500)))

# sinks
@query("upsert_latest", "SELECT event_type, user_id, max_by(id, (occurred_at, id)) AS id FROM m_user_events GROUP BY 1, 2")
def _upsert(m):
    cols = ["event_type", "user_id", "id", F.struct("occurred_at", "id").alias("stamp")]
    empty = m.user_events.where(F.lit(False)).select(*cols)
    return sinks.upsert(empty, m.user_events.select(*cols), ["event_type", "user_id"], "stamp").select("event_type", "user_id", "id")


query(
    "replace_scope",
    """SELECT id, source_type FROM m_events WHERE source_type <> 'crawl' UNION ALL SELECT 'new' || id, 'crawl' FROM m_events WHERE source_type = 'crawl'""",
)(
    lambda m: sinks.replace_scope(
        m.events.select("id", "source_type"),
        m.events.where("source_type = 'crawl'").select(F.concat(F.lit("new"), "id").alias("id"), "source_type"),
        _C("source_type") == "crawl",
    )
)


def _manifest(m):
    k = _C("page_id")
    sha = F.sha2("html", 256)
    return m.source("pages").select(
        F.when(k % 40 == 1, F.lit("same")).otherwise(F.concat(F.lit("page"), _s("page_id"))).alias("logical_name"),
        F.concat(F.lit("f/"), _s("page_id")).alias("path"),
        F.when(k % 40 == 2, F.lit("xml")).otherwise(F.lit("csv")).alias("format"),
        F.when(k % 40 == 3, F.lit("00")).otherwise(sha).alias("checksum_sha256"),
        (F.length("html") + F.when(k % 40 == 4, 1).otherwise(0)).cast("long").alias("row_count"),
    )


query(
    "verify_bundle",
    """SELECT path, CASE WHEN listed AND dup > 1 THEN 'duplicate logical_name' WHEN NOT listed THEN 'file is not listed' WHEN k = 2 THEN 'unsupported format' WHEN NOT found THEN 'missing file'
            WHEN k = 3 THEN 'checksum mismatch' WHEN k = 4 THEN 'row_count mismatch' END AS reason
       FROM (SELECT 'f/' || page_id AS path, page_id % 40 AS k, true AS listed, page_id % 40 <> 5 AS found,
                CASE WHEN page_id % 40 = 1 THEN count(*) FILTER (WHERE page_id % 40 = 1) OVER () ELSE 1 END AS dup FROM pages
             UNION ALL SELECT 'moved/' || page_id, 0, false, true, 1 FROM pages WHERE page_id % 40 = 5
             UNION ALL SELECT 'extra', 0, false, true, 1)""",
)(
    lambda m: audit.verify_bundle(
        _manifest(m),
        m.source("pages")
        .select(F.concat(F.when(F.col("page_id") % 40 == 5, "moved/").otherwise("f/"), _s("page_id")).alias("path"), F.sha2("html", 256).alias("checksum_sha256"), F.length("html").cast("long").alias("row_count"))
        .unionByName(m.source("region").agg(F.lit("extra").alias("path"), F.lit("x").alias("checksum_sha256"), F.count(F.lit(1)).alias("row_count"))),
    ).select("path", "reason")
)


@query(
    "import_audit",
    """SELECT level, code, message, row_count FROM (
        SELECT 'info' AS level, 'rows_normalized' AS code, 'rows normalized' AS message, count(*) AS row_count FROM x_feed_checked WHERE reason IS NULL
        UNION ALL SELECT 'error', 'row_rejected', reason, count(*) FROM x_feed_checked WHERE reason IS NOT NULL GROUP BY reason)""",
)
def _import_audit(m):
    ok, bad = _validated(m)
    files = m.source("pages").select(F.lit("p").alias("path"), F.sha2("html", 256).alias("checksum_sha256"), F.length("html").alias("size_bytes"), F.lit(1).alias("row_count"), F.lit("staged").alias("status"))
    _, _, reports = audit.import_audit(F.lit(1).cast("long"), F.lit("feed"), files, ok, bad, as_of())
    return reports.select("level", "code", "message", "row_count")
