"""Queries over context resolution and adjacency graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayside.functions.text import user_hash
from wayside.operators import context, graph
from wayside.plans.registry import extra_tables, query
from wayside.plans.testmap import AS_OF, as_of

_LEVEL = """CASE WHEN ({cc} IS NOT NULL OR {cn} IS NOT NULL) AND a.area_level = 'city' THEN 0
            WHEN ({pc} IS NOT NULL OR {pn} IS NOT NULL) AND a.area_level = 'prefecture' THEN 0 ELSE 1 END,
        CASE WHEN ({cc} IS NOT NULL OR {cn} IS NOT NULL) AND a.area_level = 'city' AND a.prefecture_name IS NOT NULL THEN 0 ELSE 1 END,
        a.area_id"""


def area_lookup_sql(alias: str, country="'JP'", pc=None, pn=None, cc=None, cn=None) -> str:
    """A correlated top-1 area lookup; a hint left out counts as null."""
    none = "CAST(NULL AS VARCHAR)"
    v = {"pc": pc or none, "pn": pn or none, "cc": cc or none, "cn": cn or none}
    return (
        """(SELECT a.area_id FROM m_areas a WHERE a.country_code = {country}
            AND coalesce({pc}, {pn}, {cc}, {cn}) IS NOT NULL
            AND ({cc} IS NULL OR a.city_code = {cc}) AND ({pc} IS NULL OR a.prefecture_code = {pc})
            AND ({cn} IS NULL OR lower(a.city_name) = lower({cn})) AND ({pn} IS NULL OR lower(a.prefecture_name) = lower({pn}))
        ORDER BY """
        + _LEVEL
        + " LIMIT 1)"
    ).format(country=country, **v)


extra_tables(
    x_req=f"""SELECT r.*, coalesce(station_id, target_station_id) AS st_id, coalesce(r.prefecture_name, r.city_code, r.city_name) IS NOT NULL AS has_hint,
            {area_lookup_sql("r", pn="r.prefecture_name", cc="r.city_code", cn="r.city_name")} AS hint_area,
            {area_lookup_sql("r", cc="r.city_code", cn="r.city_name")} AS hint_city_area
        FROM m_requests r""",
    x_linked="SELECT DISTINCT l.station_id, lower(s.area) AS city FROM m_links l JOIN m_schools s ON s.id = l.school_id",
    x_station_ctx="""SELECT r.request_id, s.id, s.name, s.line_name, s.line_id, NOT (
                (r.city_code IS NULL OR coalesce(lower(sa.city_code) = lower(r.city_code), false))
                AND (r.city_name IS NULL OR CASE WHEN sa.city_name IS NOT NULL THEN lower(sa.city_name) = lower(r.city_name)
                     ELSE EXISTS (SELECT 1 FROM x_linked k WHERE k.station_id = s.id AND k.city = lower(r.city_name)) END)
                AND (r.prefecture_name IS NULL OR coalesce(lower(coalesce(sa.prefecture_name, ia.prefecture_name)) = lower(r.prefecture_name), false))
            ) AND r.has_hint AS conflict
        FROM x_req r JOIN m_stations s ON s.id = r.st_id LEFT JOIN m_areas sa ON sa.area_id = s.area_id
        LEFT JOIN m_areas ia ON ia.area_id = r.hint_city_area""",
    x_recent=f"""SELECT user_id, station_id,
            0.32e0 + (0.88e0 - 0.32e0) * pow(1.0e0 - least(greatest(epoch(TIMESTAMP '{AS_OF}' - occurred_at) / 3600.0e0, 0.0e0), 72.0e0) / 72.0e0, 2) AS confidence
        FROM (SELECT e.user_id, e.target_station_id AS station_id, e.occurred_at,
                row_number() OVER (PARTITION BY e.user_id ORDER BY e.occurred_at DESC, e.id DESC) AS rn
              FROM m_user_events e JOIN m_stations s ON s.id = e.target_station_id
              WHERE e.event_type = 'search_execute' AND e.occurred_at <= TIMESTAMP '{AS_OF}'
                AND e.occurred_at >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR) WHERE rn = 1""",
    x_profile=f"""SELECT p.user_id, p.confidence, a.area_id, a.country_code, a.prefecture_code, a.prefecture_name, a.city_code, a.city_name,
            l.line_id, l.line_name, s.id AS station_id, s.name AS station_name
        FROM m_profiles p LEFT JOIN m_areas a ON a.area_id = p.area_id LEFT JOIN m_lines l ON l.line_id = p.line_id
        LEFT JOIN m_stations s ON s.id = p.station_id
        WHERE (p.retained_until IS NULL OR p.retained_until > TIMESTAMP '{AS_OF}')
          AND (a.area_id IS NOT NULL OR l.line_id IS NOT NULL OR s.id IS NOT NULL)""",
    x_pick="""SELECT r.*, sc.id AS sc_id, sc.name AS sc_name, sc.line_name AS sc_line, sc.line_id AS sc_line_id, coalesce(sc.conflict, false) AS conflict,
            CASE WHEN r.st_id IS NOT NULL THEN 'request_station' WHEN coalesce(r.line_id, r.line_name) IS NOT NULL THEN 'request_line'
                 WHEN r.has_hint THEN 'request_area'
                 WHEN p.user_id IS NOT NULL AND (q.user_id IS NULL OR p.confidence >= q.confidence) THEN 'user_profile_area'
                 WHEN q.user_id IS NOT NULL THEN 'recent_search_context' ELSE 'default_safe_context' END AS source,
            q.confidence AS q_conf, q.station_id AS q_station, p.confidence AS p_conf, p.area_id AS p_area, p.line_id AS p_line_id,
            p.line_name AS p_line, p.station_id AS p_station, p.station_name AS p_station_name
        FROM x_req r LEFT JOIN x_station_ctx sc ON sc.request_id = r.request_id
        LEFT JOIN x_recent q ON q.user_id = r.user_id LEFT JOIN x_profile p ON p.user_id = r.user_id""",
    x_ctx="""SELECT x.request_id, x.user_id, x.placement, x."limit", x.debug, x.source AS context_source,
            CASE source WHEN 'request_station' THEN 1.0e0 WHEN 'request_line' THEN 0.95e0 WHEN 'request_area' THEN 0.95e0
                WHEN 'user_profile_area' THEN p_conf WHEN 'recent_search_context' THEN q_conf ELSE 0.2e0 END AS confidence,
            CASE WHEN source = 'user_profile_area' THEN p_area IS NOT NULL WHEN source LIKE 'request%' THEN has_hint AND NOT conflict ELSE false END AS has_area,
            CASE WHEN source = 'user_profile_area' THEN pa.prefecture_name WHEN source LIKE 'request%' AND has_hint AND NOT conflict
                THEN CASE WHEN ha.area_id IS NOT NULL THEN ha.prefecture_name ELSE x.prefecture_name END END AS prefecture_name,
            CASE WHEN source = 'user_profile_area' THEN pa.city_name WHEN source LIKE 'request%' AND has_hint AND NOT conflict
                THEN CASE WHEN ha.area_id IS NOT NULL THEN ha.city_name ELSE x.city_name END END AS city_name,
            CASE WHEN source = 'user_profile_area' THEN p_area WHEN source LIKE 'request%' AND has_hint AND NOT conflict THEN x.hint_area END AS ctx_area_id,
            CASE source WHEN 'request_station' THEN sc_line_id WHEN 'request_line' THEN coalesce(l1.line_id, l2.line_id)
                WHEN 'user_profile_area' THEN p_line_id WHEN 'recent_search_context' THEN qs.line_id END AS line_id,
            CASE source WHEN 'request_station' THEN sc_line WHEN 'request_line' THEN coalesce(l1.line_name, l2.line_name, x.line_name)
                WHEN 'user_profile_area' THEN p_line WHEN 'recent_search_context' THEN qs.line_name END AS line_name,
            CASE source WHEN 'request_station' THEN sc_id WHEN 'user_profile_area' THEN p_station WHEN 'recent_search_context' THEN qs.id END AS ctx_station_id,
            CASE source WHEN 'request_station' THEN sc_name WHEN 'user_profile_area' THEN p_station_name WHEN 'recent_search_context' THEN qs.name END AS ctx_station_name,
            source = 'request_station' AND conflict AS conflict
        FROM x_pick x LEFT JOIN m_areas ha ON ha.area_id = x.hint_area LEFT JOIN m_areas pa ON pa.area_id = x.p_area
        LEFT JOIN m_lines l1 ON l1.line_id = x.line_id LEFT JOIN m_lines l2 ON l2.line_name = x.line_name
        LEFT JOIN m_stations qs ON qs.id = x.q_station""",
    x_school_pref="""SELECT s.id, s.area, s.prefecture_name, l.distance_meters, l.walking_minutes, l.station_id
        FROM m_schools s JOIN m_links l ON l.school_id = s.id""",
    x_city_spot="""SELECT c.request_id, min(struct_pack(d := s.distance_meters, w := s.walking_minutes, i := s.station_id)).i AS station_id
        FROM x_ctx c JOIN x_school_pref s ON lower(s.area) = lower(c.city_name) WHERE
            CASE WHEN c.prefecture_name IS NOT NULL THEN lower(coalesce(s.prefecture_name,
                (SELECT a.prefecture_name FROM m_areas a WHERE a.area_level = 'city' AND lower(a.city_name) = lower(s.area)
                 AND lower(a.prefecture_name) = lower(c.prefecture_name) LIMIT 1), '')) = lower(c.prefecture_name) ELSE true END
        GROUP BY c.request_id""",
    x_pref_spot="""SELECT p.prefecture_name, min(struct_pack(d := s.distance_meters, w := s.walking_minutes, i := s.station_id)).i AS station_id
        FROM (SELECT DISTINCT prefecture_name FROM x_ctx WHERE prefecture_name IS NOT NULL) p JOIN x_school_pref s
          ON lower(s.area) = lower(p.prefecture_name) OR lower(s.prefecture_name) = lower(p.prefecture_name)
          OR lower((SELECT a.prefecture_name FROM m_areas a WHERE a.area_level = 'city' AND lower(a.city_name) = lower(s.area) ORDER BY a.area_id LIMIT 1)) = lower(p.prefecture_name)
        GROUP BY p.prefecture_name""",
    x_target_id="""SELECT c.*, CASE WHEN c.ctx_station_id IS NOT NULL THEN c.ctx_station_id
            WHEN c.line_name IS NOT NULL THEN CASE WHEN c.line_id IS NOT NULL
                THEN coalesce((SELECT min(id) FROM m_stations s WHERE s.line_id = c.line_id), (SELECT min(id) FROM m_stations s WHERE s.line_id IS NULL AND s.line_name = c.line_name))
                ELSE (SELECT min(id) FROM m_stations s WHERE s.line_name = c.line_name) END
            ELSE coalesce(cs.station_id, ps.station_id, (SELECT min(id) FROM m_stations)) END AS target_station_id
        FROM x_ctx c LEFT JOIN x_city_spot cs ON cs.request_id = c.request_id LEFT JOIN x_pref_spot ps ON ps.prefecture_name = c.prefecture_name""",
    x_target="""SELECT t.*, s.name AS target_name, s.line_name AS target_line_name, s.line_id AS target_line_id, s.area_id AS target_area_id,
            s.latitude AS target_latitude, s.longitude AS target_longitude,
            coalesce(CASE WHEN NOT t.conflict THEN t.ctx_area_id END, s.area_id) AS area_origin,
            coalesce(t.line_id, CASE WHEN t.ctx_station_id IS NOT NULL THEN s.line_id END) AS line_origin,
            CASE t.placement WHEN 'detail' THEN 2 ELSE 3 END AS max_hops
        FROM x_target_id t JOIN m_stations s ON s.id = t.target_station_id""",
)

_CTX = "request_id, user_id, context_source, round(confidence, 9) AS confidence, has_area, prefecture_name, city_name, line_id, line_name, ctx_station_id, ctx_station_name, conflict"


@query("resolve_context", f"SELECT {_CTX} FROM x_ctx")
def _resolve(m):
    conflict = F.exists("warnings", lambda w: w["code"] == "station_area_conflict")
    return m.batch.context.select(
        "request_id", "user_id", "context_source", F.round("confidence", 9).alias("confidence"), "has_area", "prefecture_name", "city_name",
        "line_id", "line_name", "ctx_station_id", "ctx_station_name", conflict.alias("conflict"),
    )


@query(
    "context_errors",
    """SELECT request_id, CASE WHEN st_id IS NOT NULL THEN 'unknown station: x' || st_id ELSE 'unknown line_id: x' || line_id END AS error
       FROM x_req WHERE st_id IS NOT NULL OR line_id IS NOT NULL""",
)
def _errors(m):
    broken = m.requests.withColumns({n: F.concat(F.lit("x"), n) for n in ("target_station_id", "line_id")})
    t = m.tables
    ctx = context.resolve_context(broken, t.stations, t.lines, t.areas, t.links, t.schools, t.user_events, t.profiles, as_of())
    return ctx.where("error IS NOT NULL").select("request_id", "error")


query("request_context", "SELECT request_id, coalesce(station_id, target_station_id) AS station_id FROM m_requests")(
    lambda m: context.request_context(m.requests).select("request_id", "station_id")
)
query(
    "normalize_area",
    "SELECT request_id, 'JP' AS country, prefecture_code, prefecture_name, city_code, city_name FROM m_requests",
)(lambda m: context.normalize_area(m.requests.withColumn("city_name", F.concat(F.lit(" "), "city_name", F.lit("　")))).select("request_id", *context.HINT))
query("lookup_area", "SELECT request_id, hint_area AS area_id FROM x_req")(
    lambda m: context.lookup_area(context.normalize_area(m.requests), m.areas, {n: n for n in context.HINT}, "a").select(
        "request_id", F.col("a.area_id").alias("area_id")
    )
)
query(
    "school_area",
    """SELECT s.id, (SELECT a.area_id FROM m_areas a WHERE a.area_level = 'city' AND lower(a.city_name) = lower(s.area)
        AND (s.prefecture_name IS NULL OR a.prefecture_name IS NULL OR lower(a.prefecture_name) = lower(s.prefecture_name))
        ORDER BY CASE WHEN lower(a.prefecture_name) = lower(s.prefecture_name) THEN 0 ELSE 1 END, a.area_id LIMIT 1) AS school_area_id
       FROM m_schools s""",
)(lambda m: context.school_area(m.schools, m.areas).select("id", "school_area_id"))
query("recent_search_context", "SELECT user_id, station_id, round(confidence, 9) AS confidence FROM x_recent")(
    lambda m: context.recent_search(m.user_events, m.stations, as_of()).withColumn("confidence", F.round("confidence", 9))
)
query("profile_context", "SELECT user_id, confidence, prefecture_name, city_name, line_id, station_id AS ctx_station_id FROM x_profile")(
    lambda m: context.profile_context(m.profiles, m.areas, m.lines, m.stations, as_of()).select(
        "user_id", *[F.col(f"profile.{n}").alias(n) for n in ("confidence", "prefecture_name", "city_name", "line_id", "ctx_station_id")]
    )
)
query("station_for_context", "SELECT request_id, target_station_id, target_name, target_line_id, target_area_id FROM x_target")(
    lambda m: m.batch.targets.select("request_id", "target_station_id", "target_name", "target_line_id", "target_area_id")
)
query(
    "evidence_summary",
    """SELECT request_id, CASE context_source WHEN 'user_profile_area' THEN 'user_profile_context' WHEN 'recent_search_context' THEN 'search_execute'
            ELSE context_source END AS primary_kind, CASE WHEN context_source = 'default_safe_context' THEN 0 ELSE 1 END AS evidence_count,
            CASE WHEN context_source = 'default_safe_context' THEN 0.0e0 ELSE round(confidence, 9) END AS strongest_strength,
            context_source = 'recent_search_context' AS has_search_execute FROM x_ctx""",
)(lambda m: context.evidence_summary(m.batch.context).withColumn("strongest_strength", F.round("strongest_strength", 9)))
query(
    "context_traces",
    """SELECT request_id, CASE WHEN user_id IS NOT NULL THEN sha256('salt' || chr(0) || user_id) END AS user_id_hash, context_source, round(confidence, 9) AS confidence,
        ctx_area_id AS area_id, line_id, ctx_station_id AS station_id FROM x_ctx""",
)(lambda m: context.context_traces(m.batch.context, m.areas, "salt").drop("warnings").withColumn("confidence", F.round("confidence", 9)))
@query(
    "resolve_hierarchy",
    """SELECT request_id, source AS context_source, CASE source WHEN 'request_line' THEN 0.9e0 WHEN 'request_area' THEN 0.85e0 WHEN 'user_profile_area' THEN 0.6e0 ELSE 0.2e0 END AS confidence,
            CAST(NULL AS VARCHAR) AS ctx_station_id, CASE WHEN source = 'request_line' THEN line_id END AS line_id,
            CASE WHEN source = 'request_line' THEN coalesce(line_name, '') END AS line_name,
            CASE WHEN source = 'user_profile_area' THEN p_city WHEN source LIKE 'request%' THEN city_name END AS city_name,
            CASE WHEN source = 'user_profile_area' THEN p_pref WHEN source LIKE 'request%' THEN prefecture_name END AS prefecture_name
       FROM (SELECT r.*, a.city_name AS p_city, a.prefecture_name AS p_pref, CASE WHEN coalesce(r.line_id, r.line_name) IS NOT NULL THEN 'request_line'
                WHEN coalesce(r.prefecture_name, r.city_code, r.city_name) IS NOT NULL THEN 'request_area'
                WHEN a.area_id IS NOT NULL THEN 'user_profile_area' ELSE 'default_safe_context' END AS source
             FROM m_requests r LEFT JOIN m_profiles p ON p.user_id = r.user_id LEFT JOIN m_areas a ON a.area_id = p.area_id)""",
)
def _hierarchy(m):
    names = [n for n in context.HINT if n != "country"]
    areas = m.profiles.select("user_id", "area_id").join(m.areas, "area_id").select("user_id", *[F.col(n).alias(f"profile_{n}") for n in names])
    return context.resolve_hierarchy(m.requests.join(areas, "user_id", "left"))


query(
    "decay_evidence",
    f"""SELECT user_id, round(confidence * (CASE WHEN age <= 0 THEN 1.0e0 ELSE 1.0e0 - pow(least(age / 720.0e0, 1.0e0), 2) END), 9) AS decayed
        FROM (SELECT user_id, 0.9e0 AS confidence, epoch(TIMESTAMP '{AS_OF}' - max(occurred_at)) / 3600.0e0 AS age FROM m_user_events GROUP BY user_id)""",
)(
    lambda m: context.decay_evidence(
        m.user_events.groupBy("user_id").agg(F.max("occurred_at").alias("t")).select(
            "user_id", F.lit(0.9).alias("confidence"), context.hours_between(as_of(), F.col("t")).alias("age_hours")
        ),
        720.0,
    ).select("user_id", F.round("decayed", 9).alias("decayed"))
)


def _sessions(m):
    """One session per user of the log, keyed by a salted hash."""
    return m.user_events.groupBy("user_id").agg(
        F.min("occurred_at").alias("first_seen_at"), F.max("occurred_at").alias("last_seen_at"), F.count(F.lit(1)).alias("evidence_count"),
        F.count_if(F.col("event_type") == "search_execute").alias("search_execute_count"),
    ).select(
        user_hash("s", F.col("user_id")).alias("session_id_hash"), F.lit("recent_behavior_context").alias("context_source"), F.lit(0.5).alias("confidence"),
        F.lit("coarse_area").alias("privacy_level"), F.lit("search_execute").alias("primary_kind"), "evidence_count", "search_execute_count",
        F.lit(0).cast("long").alias("warning_count"), F.lit(None).cast("string").alias("area_id"), F.lit(None).cast("string").alias("line_id"),
        F.lit(None).cast("string").alias("station_id"), "first_seen_at", "last_seen_at",
    )


query(
    "recent_sessions",
    """SELECT sha256('s' || chr(0) || user_id) AS session_id_hash, count(*) AS evidence_count, max(occurred_at) AS last_seen_at
       FROM m_user_events GROUP BY user_id ORDER BY 3 DESC, 1 LIMIT 50""",
)(lambda m: context.recent_sessions(_sessions(m), 50).select("session_id_hash", "evidence_count", "last_seen_at"))
query(
    "context_shape_issues",
    """SELECT request_id, context_source, shape FROM (
        SELECT request_id, CASE context_source WHEN 'request_station' THEN 'request_area' ELSE context_source END AS context_source,
            concat_ws('+', CASE WHEN has_area THEN 'area' END, CASE WHEN line_name IS NOT NULL THEN 'line' END, CASE WHEN ctx_station_id IS NOT NULL THEN 'station' END) AS shape FROM x_ctx)
       WHERE NOT CASE context_source WHEN 'request_area' THEN shape = 'area' WHEN 'request_line' THEN shape IN ('line', 'area+line') WHEN 'user_profile_area' THEN shape <> ''
            WHEN 'recent_search_context' THEN shape = 'line+station' ELSE shape = '' END""",
)(
    lambda m: context.context_shape_issues(
        m.batch.context.withColumn("context_source", F.when(F.col("context_source") == "request_station", F.lit("request_area")).otherwise(F.col("context_source")))
    )
)

query(
    "graph_origins",
    """SELECT request_id, area_origin, line_origin FROM x_target""",
)(lambda m: m.batch.rows.select("request_id", "area_origin", "line_origin"))
query(
    "expand_lines",
    """SELECT t.request_id, e.to_line_id AS adjacent FROM x_target t JOIN (SELECT DISTINCT from_line_id, to_line_id FROM m_line_adjacencies) e
       ON e.from_line_id = t.line_origin WHERE e.to_line_id <> t.line_origin""",
)(lambda m: graph.expand_lines(m.batch.rows, m.line_adjacencies).select("request_id", F.explode("adjacent_lines").alias("adjacent")))
query(
    "expand_areas",
    """SELECT t.request_id, e.to_area_id AS adjacent FROM x_target t JOIN (SELECT DISTINCT from_area_id, to_area_id FROM m_area_adjacencies) e
       ON e.from_area_id = t.area_origin WHERE e.to_area_id <> t.area_origin""",
)(lambda m: graph.expand_areas(m.batch.rows, m.area_adjacencies).select("request_id", F.explode("adjacent_areas").alias("adjacent")))
query(
    "order_area_edges",
    """SELECT from_area_id, to_area_id, CAST(row_number() OVER (PARTITION BY from_area_id ORDER BY adjacency_kind, distance_meters NULLS LAST, to_area_id, area_cluster_id NULLS LAST) AS INTEGER) AS edge_order
       FROM m_area_adjacencies""",
)(lambda m: graph.order_area_edges(m.area_adjacencies).select("from_area_id", "to_area_id", "edge_order"))
query(
    "station_hops",
    """SELECT from_line_id, CAST(row_number() OVER (PARTITION BY from_line_id ORDER BY adjacency_kind, station_hop_count NULLS LAST, interchange_station_id NULLS LAST, to_line_id, requires_transfer) AS INTEGER) AS edge_order,
        to_line_id, adjacency_kind, station_hop_count, interchange_station_id, requires_transfer FROM m_line_adjacencies""",
)(lambda m: graph.station_hops(m.line_adjacencies))
query(
    "area_clusters",
    """SELECT from_area_id AS origin_area_id, area_cluster_id, array_to_string(list_sort(list(DISTINCT a)), ',') AS observed
       FROM (SELECT from_area_id, area_cluster_id, unnest([from_area_id, to_area_id]) AS a FROM m_area_adjacencies) GROUP BY ALL""",
)(lambda m: graph.area_clusters(m.area_adjacencies).select("origin_area_id", "area_cluster_id", F.array_join("observed_area_ids", ",").alias("observed")))
query(
    "interchanges",
    """SELECT from_line_id, interchange_station_id, array_to_string(list_sort(list(DISTINCT to_line_id)), ',') AS lines, bool_or(requires_transfer) AS requires_transfer,
        min(station_hop_count) AS minimum_station_hop_count FROM m_line_adjacencies WHERE interchange_station_id IS NOT NULL GROUP BY 1, 2""",
)(
    lambda m: graph.interchanges(m.line_adjacencies).select(
        "from_line_id", "interchange_station_id", F.array_join("to_line_ids", ",").alias("lines"), "requires_transfer", "minimum_station_hop_count"
    )
)
query(
    "validate_adjacency",
    """SELECT from_area_id, to_area_id, CASE WHEN from_area_id = to_area_id THEN 'adjacency must connect different ends'
        WHEN distance_meters < 0 THEN 'distance_meters must not be negative' END AS reason FROM (
        SELECT from_area_id, CASE WHEN distance_meters = 5000 THEN from_area_id ELSE to_area_id END AS to_area_id, distance_meters - 5000.0e0 AS distance_meters FROM m_area_adjacencies)""",
)(
    lambda m: graph.validate_adjacency(
        m.area_adjacencies.withColumn("to_area_id", F.when(F.col("distance_meters") == 5000, F.col("from_area_id")).otherwise(F.col("to_area_id"))).withColumn(
            "distance_meters", F.col("distance_meters") - 5000.0
        ),
        "from_area_id",
        "to_area_id",
    ).select("from_area_id", "to_area_id", "reason")
)


@query(
    "graph_diagnostics",
    """SELECT t.request_id, t.area_origin, t.line_origin, coalesce(a.n, 0) AS area_edge_count, coalesce(l.n, 0) AS line_edge_count,
            coalesce(l.c, 0) AS interchange_count, coalesce(a.s, '') AS area_sample,
            array_to_string(list_sort(list_filter([CASE WHEN t.conflict THEN 'area_context_ignored_by_station_conflict' END,
                CASE WHEN NOT t.conflict AND t.has_area AND t.ctx_area_id IS NULL THEN 'context_area_id_unresolved' END,
                CASE WHEN t.area_origin IS NULL THEN 'geo_graph_origin_unavailable' END,
                CASE WHEN t.line_origin IS NULL THEN 'line_graph_origin_unavailable' END], lambda x: x IS NOT NULL)), ',') AS warnings
       FROM x_target t
       LEFT JOIN (SELECT from_area_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT to_area_id))[1:8], ',') AS s FROM m_area_adjacencies GROUP BY 1) a ON a.from_area_id = t.area_origin
       LEFT JOIN (SELECT from_line_id, count(*) AS n, count(DISTINCT interchange_station_id) AS c FROM m_line_adjacencies GROUP BY 1) l ON l.from_line_id = t.line_origin""",
)
def _diagnostics(m):
    out = graph.graph_diagnostics(m.batch.rows, m.area_adjacencies, m.line_adjacencies)
    return out.select(
        "request_id", "area_origin", "line_origin", "area_edge_count", "line_edge_count", "interchange_count",
        F.array_join("adjacent_area_sample", ",").alias("area_sample"), F.array_join("graph_warnings", ",").alias("warnings"),
    )


@query(
    "prefecture_neighbors",
    "SELECT prefecture_code, neighbor_code, count(*) AS requests FROM ("
    " SELECT lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') AS prefecture_code FROM customer) JOIN ("
    " SELECT DISTINCT unnest([a, b]) AS prefecture_code, unnest([b, a]) AS neighbor_code FROM (VALUES "
    + ", ".join(f"('{a}', '{b}')" for a, others in graph.PREFECTURE_BORDERS.items() for b in others)
    + ") v(a, b)) USING (prefecture_code) GROUP BY 1, 2",
)
def _prefectures(m):
    homes = m.source("customer").select(F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0").alias("prefecture_code"))
    per = homes.groupBy("prefecture_code").agg(F.count(F.lit(1)).alias("requests"))
    return graph.prefecture_neighbors(per).select("prefecture_code", "neighbor_code", "requests")
