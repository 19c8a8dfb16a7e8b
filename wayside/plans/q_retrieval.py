"""Queries over candidate retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayside.config import DEFAULT_CONFIG
from wayside.operators import ranking, retrieval
from wayside.plans.registry import extra_tables, query
from wayside.plans.testmap import ellipsoid_sql, sphere_sql
from wayside.session import settle

_SAME_LINE = """((t.line_id IS NOT NULL AND l.candidate_line_id = t.line_id)
    OR (t.line_name IS NOT NULL AND (t.line_id IS NULL OR l.candidate_line_id IS NULL) AND l.line_name = t.line_name))"""
_IN_PREF = "(lower(l.school_area) = lower(t.prefecture_name) OR lower(coalesce(l.school_prefecture_name, '')) = lower(t.prefecture_name))"

extra_tables(
    x_elink="""SELECT l.*, s.line_id AS candidate_line_id, s.area_id AS candidate_area_id, s.name AS candidate_name, s.line_name AS station_line_name,
            s.latitude, s.longitude, c.name AS school_name, c.area AS school_area, c.prefecture_name AS own_prefecture, c.group_id,
            coalesce(c.prefecture_name, (SELECT a.prefecture_name FROM m_areas a WHERE a.area_level = 'city' AND lower(a.city_name) = lower(c.area)
                ORDER BY a.area_id LIMIT 1)) AS school_prefecture_name
        FROM m_links l JOIN m_stations s ON s.id = l.station_id JOIN m_schools c ON c.id = l.school_id""",
    x_line_near="SELECT DISTINCT from_line_id, to_line_id FROM m_line_adjacencies",
    x_area_near="SELECT DISTINCT from_area_id, to_area_id FROM m_area_adjacencies",
    x_pairs=f"""SELECT t.*, l.* EXCLUDE (line_name), l.line_name AS link_line_name, ea.from_area_id IS NOT NULL AS adjacent_area, el.from_line_id IS NOT NULL AS adjacent_line,
            {ellipsoid_sql("t.target_latitude", "t.target_longitude", "l.latitude", "l.longitude")} AS d,
            {_SAME_LINE} AS same_line, {_IN_PREF} AS in_pref
        FROM x_target t CROSS JOIN x_elink l
        LEFT JOIN x_area_near ea ON ea.from_area_id = t.area_origin AND ea.to_area_id = l.candidate_area_id
        LEFT JOIN x_line_near el ON el.from_line_id = t.line_origin AND el.to_line_id = l.candidate_line_id""",
    x_bucketed="""SELECT *, CASE WHEN ctx_station_id IS NOT NULL AND station_id = ctx_station_id THEN 0
            WHEN same_line THEN 1
            WHEN adjacent_line AND hop_distance <= max_hops AND d <= 2500 THEN 2
            WHEN city_name IS NOT NULL AND lower(school_area) = lower(city_name) AND (prefecture_name IS NULL OR lower(coalesce(school_prefecture_name, '')) = lower(prefecture_name)) THEN 3
            WHEN prefecture_name IS NOT NULL AND in_pref THEN 4
            WHEN ctx_station_id IS NOT NULL AND station_id <> target_station_id AND NOT same_line AND (city_name IS NULL OR lower(school_area) <> lower(city_name))
                AND (prefecture_name IS NULL OR NOT in_pref) AND (d <= 2500 OR adjacent_area) THEN 5
            ELSE 6 END AS bucket FROM x_pairs""",
    x_candidates="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY bucket, CASE WHEN bucket = 6 THEN d ELSE 0.0e0 END,
                distance_meters, walking_minutes, school_id, station_id) AS position
            FROM (SELECT *, count(*) FILTER (WHERE bucket < 6) OVER (PARTITION BY request_id) AS scoped FROM x_bucketed)
            WHERE bucket < 6 OR scoped < 2) WHERE position <= 256""",
)

query(
    "context_candidates",
    "SELECT request_id, school_id, station_id, CAST(position AS INTEGER) AS position, CAST(bucket AS INTEGER) AS bucket FROM x_candidates",
)(
    lambda m: m.batch.rows.select("request_id", "sig")
    .join(m.batch.candidates, "sig")
    .select("request_id", "school_id", "station_id", "position", "bucket")
)


def _targets(m):
    """Requests that name a station, with its columns."""
    return m.batch.rows.where("explicit")


_LINE_NEAR = f"""{ellipsoid_sql("t.target_latitude", "t.target_longitude", "l.latitude", "l.longitude")} <= 2500"""
query(
    "station_candidates",
    f"""SELECT * FROM (SELECT t.request_id, l.school_id, l.station_id, CAST(row_number() OVER (PARTITION BY t.request_id ORDER BY
            CASE WHEN l.station_id = t.target_station_id THEN 0 ELSE 1 END, distance_meters, walking_minutes, school_id, station_id) AS INTEGER) AS position
        FROM x_target t JOIN x_elink l ON l.station_id = t.target_station_id
            OR (l.line_name = t.target_line_name AND l.hop_distance <= t.max_hops AND {_LINE_NEAR})
        WHERE t.ctx_station_id IS NOT NULL) WHERE position <= 256""",
)(lambda m: retrieval.station_candidates(_targets(m), m.batch.enriched).select("request_id", "school_id", "station_id", "position"))

extra_tables(
    x_projection="""SELECT l.school_id || ':' || l.station_id AS document_id, l.school_id, l.school_name, l.school_area, c.school_type, l.station_id, l.candidate_name AS station_name,
            l.station_line_name AS line_name, l.latitude, l.longitude, l.walking_minutes, l.distance_meters, l.hop_distance,
            coalesce(e.n, 0) AS open_day_count, coalesce(p.popularity_score, 0.0e0) AS popularity_score
        FROM x_elink l JOIN m_schools c ON c.id = l.school_id
        LEFT JOIN (SELECT school_id, count(*) FILTER (WHERE is_open_day) AS n FROM m_events WHERE is_active GROUP BY 1) e ON e.school_id = l.school_id
        LEFT JOIN m_popularity p ON p.school_id = l.school_id""",
    x_indexed=f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY boost DESC, distance_meters, walking_minutes, school_id, station_id) AS hit
            FROM (SELECT t.request_id, t.target_station_id, p.*, CASE WHEN p.station_id = t.target_station_id THEN 3.0e0 WHEN p.line_name = t.target_line_name THEN 1.0e0
                    WHEN {sphere_sql("t.target_latitude", "t.target_longitude", "p.latitude", "p.longitude")} <= 2500 THEN 0.5e0 END AS boost
                  FROM x_target t CROSS JOIN x_projection p WHERE t.ctx_station_id IS NOT NULL) WHERE boost IS NOT NULL) WHERE hit <= 256""",
)


def _projection(m):
    return retrieval.build_projection(m.links, m.schools, m.stations, m.events, m.popularity)


query("build_projection", "SELECT * REPLACE (round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, round(popularity_score, 9) AS popularity_score) FROM x_projection")(
    lambda m: _projection(m).withColumns(
        {"latitude": F.round("latitude", 6), "longitude": F.round("longitude", 6), "popularity_score": F.round("popularity_score", 9)}
    )
)
_INDEX_POSITION = """CAST(row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN station_id = target_station_id THEN 0 ELSE 1 END,
    distance_meters, walking_minutes, school_id, station_id) AS INTEGER) AS position"""
query("projection_candidates", f"SELECT request_id, school_id, station_id, boost, {_INDEX_POSITION} FROM x_indexed")(
    lambda m: retrieval.projection_candidates(_targets(m), _projection(m)).select("request_id", "school_id", "station_id", "boost", "position")
)


def _retrieved(m):
    index = retrieval.projection_candidates(_targets(m), _projection(m))
    return retrieval.retrieve(m.batch.rows, m.batch.candidates, index)


query(
    "retrieve_by_mode",
    f"""WITH ranked AS (SELECT request_id, school_id, station_id, {_INDEX_POSITION}, count(*) OVER (PARTITION BY request_id) AS n FROM x_indexed),
        ok AS (SELECT DISTINCT r.request_id FROM ranked r JOIN x_target t ON t.request_id = r.request_id WHERE n >= 2 AND NOT t.has_area)
       SELECT request_id, school_id, station_id, position, 'index' AS backend FROM ranked WHERE request_id IN (SELECT request_id FROM ok)
       UNION ALL SELECT request_id, school_id, station_id, CAST(position AS INTEGER), 'sql' FROM x_candidates WHERE request_id NOT IN (SELECT request_id FROM ok)""",
)(lambda m: _retrieved(m).select("request_id", "school_id", "station_id", "position", "backend"))
def _renamed(documents, prefix):
    """All documents, and each once more under another id."""
    return documents.unionByName(documents.withColumn("document_id", F.concat(F.lit(prefix), "document_id")))


query(
    "projection_diff",
    """SELECT document_id, 'upsert' AS action FROM x_projection UNION ALL SELECT 'new:' || document_id, 'upsert' FROM x_projection
       UNION ALL SELECT 'gone:' || document_id, 'delete' FROM x_projection""",
)(lambda m: retrieval.projection_diff(_renamed(_projection(m), "gone:"), _renamed(_projection(m), "new:")))


def _slice(m):
    """Every row of the slice of all candidates, as JSON; held against plain Python in the tests."""
    links = settle(retrieval.retrieved_links(m.batch.lists))  # each part reads it
    dims = {
        "schools": m.schools, "stations": m.stations, "events": m.events, "popularity": m.popularity,
        "area_affinity": m.area_affinity, "user_affinity": m.user_affinity,
    }
    out = None
    for name, part in retrieval.candidate_slice(links, dims).items():
        rows = part.select(F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


query("candidate_slice")(_slice)
query(
    "retrieval_parity",
    f"""SELECT request_id, count(a_school) AS left_rows, count(b_school) AS right_rows, bool_and(a_school IS NOT DISTINCT FROM b_school AND a_station IS NOT DISTINCT FROM b_station) AS same_order
        FROM (SELECT request_id, position, school_id AS a_school, station_id AS a_station FROM x_candidates WHERE ctx_station_id IS NOT NULL) a
        FULL JOIN (SELECT request_id, position, school_id AS b_school, station_id AS b_station FROM (SELECT *, {_INDEX_POSITION} FROM x_indexed)) b USING (request_id, position) GROUP BY 1""",
)(
    lambda m: retrieval.retrieval_parity(
        _targets(m).select("request_id", "sig").join(m.batch.candidates, "sig"), retrieval.projection_candidates(_targets(m), _projection(m))
    )
)

# ranking
_TL = "CASE WHEN x.line_name IS NOT NULL THEN x.line_id ELSE x.target_line_id END"
extra_tables(
    x_evidence=f"""SELECT x.*, {sphere_sql("x.target_latitude", "x.target_longitude", "x.latitude", "x.longitude")} AS sd,
            CASE WHEN {_TL} IS NOT NULL THEN CASE WHEN coalesce(x.candidate_line_id = {_TL}, false) THEN 'line_id'
                    WHEN {_TL} = x.line_origin AND x.adjacent_line THEN 'line_graph_adjacent_line_id'
                    WHEN x.candidate_line_id IS NULL AND x.link_line_name = coalesce(x.line_name, x.target_line_name) THEN 'line_name_fallback' ELSE 'none' END
                 WHEN x.link_line_name = coalesce(x.line_name, x.target_line_name) THEN 'line_name' ELSE 'none' END AS match_kind,
            x.adjacent_area AND coalesce(x.target_area_id, CASE WHEN x.has_area AND NOT x.conflict THEN x.area_origin END) = x.area_origin AS near_area
        FROM x_candidates x""",
    x_flags="""SELECT e.*, match_kind <> 'none' AND (match_kind <> 'line_graph_adjacent_line_id' OR (sd <= 2500 AND hop_distance <= max_hops)) AS on_line,
            coalesce(lower(school_area) = lower(city_name) AND (prefecture_name IS NULL OR coalesce(lower(own_prefecture) = lower(prefecture_name), false)), false) AS in_city,
            coalesce(prefecture_name IS NOT NULL AND (coalesce(lower(own_prefecture) = lower(prefecture_name), false) OR lower(school_area) = lower(prefecture_name)), false) AS in_pref2
        FROM x_evidence e""",
    x_stages="""SELECT *, ctx_station_id IS NOT NULL AND station_id = target_station_id AS s0, (line_name IS NOT NULL OR ctx_station_id IS NOT NULL) AND on_line AS s1,
            in_city AS s2, in_pref2 AS s3, ctx_station_id IS NOT NULL AND station_id <> target_station_id AND NOT on_line AND NOT in_city AND NOT in_pref2
                AND (sd <= 2500 OR coalesce(near_area, false)) AS s4 FROM x_flags""",
    x_counts="""SELECT request_id, any_value(ctx_station_id) AS ctx_station_id, any_value(line_name) AS line_name, any_value(city_name) AS city_name,
            any_value(prefecture_name) AS prefecture_name, bool_or(conflict) AS conflict,
            CAST(count(*) FILTER (WHERE s0) AS INTEGER) AS n0, CAST(count(*) FILTER (WHERE s1) AS INTEGER) AS n1, CAST(count(*) FILTER (WHERE s2) AS INTEGER) AS n2,
            CAST(count(*) FILTER (WHERE s3) AS INTEGER) AS n3, CAST(count(*) FILTER (WHERE s4) AS INTEGER) AS n4, CAST(count(*) AS INTEGER) AS n5 FROM x_stages GROUP BY 1""",
    x_plan="""SELECT *, coalesce(CASE WHEN n0 >= 2 THEN 0 WHEN n1 >= 2 THEN 1 WHEN n2 >= 2 THEN 2 WHEN n3 >= 2 THEN 3 WHEN n4 >= 2 THEN 4 END,
            CASE WHEN coalesce(city_name, prefecture_name) IS NOT NULL THEN CASE WHEN n2 > 0 THEN 2 WHEN n3 > 0 THEN 3 END END,
            CASE WHEN n5 >= 2 THEN 5 END, 5 - (list_position([n5, n4, n3, n2, n1, n0], greatest(n0, n1, n2, n3, n4, n5)) - 1)) AS stage,
            CASE WHEN greatest(n0, n1, n2, n3, n4) >= 2 THEN 'sufficient_scoped' WHEN coalesce(city_name, prefecture_name) IS NOT NULL AND n2 + n3 > 0 THEN 'underfilled_area'
                WHEN n5 >= 2 THEN 'sufficient_global' ELSE 'best_available' END AS selection FROM x_counts""",
)
_NAMES = "['strict_station', 'same_line', 'same_city', 'same_prefecture', 'neighbor_area', 'safe_global_popular']"
query(
    "stage_selection",
    f"""SELECT request_id, n0, n1, n2, n3, n4, n5, {_NAMES}[stage + 1] AS fallback_stage, selection FROM x_plan""",
)(
    lambda m: m.batch.rows.select("request_id", "sig")
    .join(m.batch.planned[0], "sig")
    .select("request_id", *[F.get("counts", F.lit(i)).alias(f"n{i}") for i in range(6)], "fallback_stage", "selection")
)
query(
    "plan_trace",
    f"""SELECT p.request_id, CAST(i AS INTEGER) AS stage_order, {_NAMES}[i + 1] AS stage, n AS candidate_count,
            CASE WHEN i = p.stage THEN 'selected' WHEN i > p.stage AND selection <> 'best_available' THEN 'skipped' ELSE 'insufficient' END AS status,
            CASE WHEN i = p.stage THEN CASE selection WHEN 'sufficient_scoped' THEN 'selected_sufficient_scoped_candidates' WHEN 'underfilled_area' THEN 'selected_underfilled_area_context'
                    WHEN 'sufficient_global' THEN 'selected_sufficient_safe_global_candidates' ELSE 'selected_best_available_non_empty_stage' END
                 WHEN i > p.stage AND selection <> 'best_available' THEN 'not_needed_after_selected_stage'
                 WHEN n > 0 AND n < 2 THEN CASE i WHEN 1 THEN 'line_graph_same_line_candidates_below_minimum' WHEN 4 THEN 'area_graph_neighbor_candidates_below_minimum' ELSE 'candidate_count_below_minimum' END
                 WHEN i IN (0, 4) AND ctx_station_id IS NULL THEN 'station_context_not_explicit'
                 WHEN i = 1 AND ctx_station_id IS NULL AND line_name IS NULL THEN 'line_context_not_explicit'
                 WHEN i = 1 THEN 'line_graph_no_same_line_candidates' WHEN i IN (2, 3) AND conflict THEN 'area_hint_ignored_by_station_conflict'
                 WHEN i = 2 AND city_name IS NULL THEN 'city_context_missing' WHEN i = 3 AND prefecture_name IS NULL THEN 'prefecture_context_missing'
                 WHEN i = 4 THEN 'area_graph_no_neighbor_candidates_within_distance_cap' ELSE 'candidate_count_below_minimum' END AS reason_code
       FROM (SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS i, unnest([n0, n1, n2, n3, n4, n5]) AS n FROM x_plan) p""",
)(
    lambda m: m.batch.rows.select("request_id", "sig")
    .join(m.batch.planned[0], "sig")
    .select("request_id", F.posexplode("stages").alias("stage_order", "s"))
    .select("request_id", "stage_order", "s.stage", "s.candidate_count", "s.status", "s.reason_code")
)
query(
    "route_evidence",
    """SELECT request_id, school_id, station_id, match_kind, CASE WHEN sd <= 250 THEN 'very_near_station' WHEN sd <= 1000 THEN 'walkable_neighbor'
            WHEN sd <= 2500 THEN 'nearby_area' ELSE 'outside_neighbor_cap' END AS distance_bucket, round(sd, 2) AS metres,
            sd <= 250 AND station_id <> target_station_id AND lower(candidate_name) = lower(target_name) AND match_kind = 'none' AS interchange_like,
            on_line AS counts_as_same_line, coalesce(near_area, false) AS is_adjacent_area FROM x_flags""",
)(
    lambda m: ranking.route_evidence(
        retrieval.signature_links(m.batch.lists, retrieval.with_requests(m.batch.signatures, m.batch.rows)).join(m.batch.dims, ["school_id", "station_id"])
    )
    .withColumn("_request", F.explode("requests"))
    .withColumn("request_id", F.col("_request.request_id"))
    .select(
        "request_id", "school_id", "station_id", "match_kind", "distance_bucket", F.round("station_distance_meters", 2).alias("metres"), "interchange_like",
        "counts_as_same_line", "is_adjacent_area",
    )
)

def _pl(attr: str) -> str:
    cases = " ".join(f"WHEN '{p.name}' THEN CAST({getattr(p, attr)} AS DOUBLE)" for p in DEFAULT_CONFIG.placements)
    return f"CASE placement {cases} END"


extra_tables(
    x_selected="""SELECT s.*, p.stage, least(greatest(coalesce("limit", 3), 1), 20) AS cap FROM x_stages s JOIN x_plan p ON p.request_id = s.request_id
        WHERE CASE p.stage WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 WHEN 4 THEN s4 ELSE true END""",
    x_base=f"""SELECT s.*, p.popularity_score * 0.75e0 AS c6, a.affinity_score * 0.35e0 AS c7, u.affinity_score * 0.9e0 AS c8,
            CASE WHEN station_id = target_station_id THEN 3.0e0 ELSE 0.0e0 END
            + CASE WHEN on_line THEN CASE WHEN stage = 4 THEN {_pl("same_line_bonus")} ELSE 1.25e0 END ELSE 0.0e0 END
            + greatest(1600.0e0 - distance_meters, 0.0e0) / 1600.0e0 + greatest(20.0e0 - walking_minutes, 0.0e0) / 20.0e0
            + greatest(2500.0e0 - sd, 0.0e0) / 2500.0e0 + coalesce(p.popularity_score * 0.75e0, 0.0e0) + coalesce(a.affinity_score * 0.35e0, 0.0e0)
            + coalesce(u.affinity_score * 0.9e0, 0.0e0) + CASE stage WHEN 4 THEN -0.8e0 WHEN 5 THEN -1.6e0 ELSE 0.0e0 END AS base
        FROM x_selected s LEFT JOIN m_popularity p ON p.school_id = s.school_id LEFT JOIN m_area_affinity a ON a.area = s.school_area
        LEFT JOIN m_user_affinity u ON u.user_id = s.user_id AND u.school_id = s.school_id""",
    x_items=f"""SELECT request_id, placement, cap, stage, school_id, group_id, station_id, 'school' AS content_kind, school_id AS content_id, base + {_pl("school_boost")} AS score FROM x_base
        UNION ALL
        SELECT request_id, placement, cap, stage, b.school_id, group_id, station_id, 'event', e.id, base + {_pl("event_boost")} + CASE WHEN e.is_open_day THEN 0.6e0 ELSE 0.0e0 END
            + CASE WHEN e.is_featured THEN {_pl("featured_bonus")} ELSE 0.0e0 END + CASE WHEN e.priority_weight > 0 THEN e.priority_weight * {_pl("priority_weight")} ELSE 0.0e0 END
        FROM x_base b JOIN m_events e ON e.school_id = b.school_id AND e.is_active AND (len(e.placement_tags) = 0 OR list_contains(e.placement_tags, b.placement))""",
    x_ranked="""SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, content_kind, content_id, station_id) AS r
        FROM (SELECT *, row_number() OVER (PARTITION BY request_id, content_kind, content_id ORDER BY score DESC, station_id) AS k FROM x_items) WHERE k = 1""",
    # five rounds are enough: the largest limit in the requests is five
    x_caps=f"""SELECT DISTINCT request_id, cap, least(greatest(CAST(ceil(cap * {_pl("school_ratio")}) AS INTEGER), 1), cap) AS cap_school,
            least(greatest(CAST(ceil(cap * {_pl("event_ratio")}) AS INTEGER), 1), cap) AS cap_event FROM x_ranked""",
    x_pick1="SELECT request_id, 1 AS position, min(r) AS r FROM x_ranked GROUP BY 1",
)
for _i in range(2, 6):
    _prev = " UNION ALL ".join(f"SELECT * FROM x_pick{j}" for j in range(1, _i))
    extra_tables(
        **{
            f"x_state{_i}": f"""SELECT p.request_id, max(p.r) AS last, list(x.school_id) AS schools, list(x.group_id) AS groups,
                count(*) FILTER (WHERE content_kind = 'school') AS ns, count(*) FILTER (WHERE content_kind = 'event') AS ne
                FROM ({_prev}) p JOIN x_ranked x ON x.request_id = p.request_id AND x.r = p.r GROUP BY 1 HAVING count(*) = {_i - 1}""",
            f"x_pick{_i}": f"""SELECT x.request_id, {_i} AS position, min(x.r) AS r FROM x_ranked x JOIN x_state{_i} s ON s.request_id = x.request_id
                JOIN x_caps c ON c.request_id = x.request_id WHERE c.cap >= {_i} AND x.r > s.last AND NOT list_contains(s.schools, x.school_id)
                AND len(list_filter(s.groups, lambda g: g = x.group_id)) < 2
                AND CASE x.content_kind WHEN 'school' THEN s.ns < c.cap_school ELSE s.ne < c.cap_event END GROUP BY 1""",
        }
    )
extra_tables(
    x_picks=" UNION ALL ".join(f"SELECT * FROM x_pick{j}" for j in range(1, 6)),
    x_result=f"""SELECT x.*, p.position, {_NAMES}[x.stage + 1] AS fallback_stage FROM x_picks p JOIN x_ranked x ON x.request_id = p.request_id AND x.r = p.r""",
    x_skipped="""SELECT request_id, count(*) FILTER (WHERE why = 'school') AS same_school, count(*) FILTER (WHERE why = 'group') AS same_group,
            count(*) FILTER (WHERE why = 'kind_school') AS kind_school, count(*) FILTER (WHERE why = 'kind_event') AS kind_event
        FROM (SELECT x.request_id, CASE WHEN count(*) FILTER (WHERE q.r < x.r AND y.school_id = x.school_id) >= 1 THEN 'school'
                WHEN count(*) FILTER (WHERE q.r < x.r AND y.group_id = x.group_id) >= 2 THEN 'group' ELSE 'kind_' || any_value(x.content_kind) END AS why
              FROM x_ranked x JOIN x_picks q ON q.request_id = x.request_id JOIN x_ranked y ON y.request_id = q.request_id AND y.r = q.r
              JOIN (SELECT request_id, max(r) AS last, count(*) AS n FROM x_picks GROUP BY 1) z ON z.request_id = x.request_id
              WHERE (x.r < z.last OR z.n < x.cap) GROUP BY x.request_id, x.r HAVING NOT bool_or(q.r = x.r)) GROUP BY 1""",
)

query("base_scores", "SELECT request_id, school_id, station_id, round(base, 6) AS base_score FROM x_base")(
    lambda m: m.batch.classes[0].select("request_id", "class_id").join(m.batch.scored, "class_id").select("request_id", "school_id", "station_id", F.round("base_score", 6).alias("base_score"))
)
query(
    "content_items",
    """SELECT request_id, content_kind, count(*) AS items, round(max(score), 6) AS best, round(sum(score), 3) AS total FROM x_items GROUP BY 1, 2""",
)(
    lambda m: m.batch.classes[0].select("request_id", "class_id")
    .join(ranking.item_totals(m.batch.base, m.batch.visible), "class_id")
    .groupBy("request_id", "content_kind")
    .agg(F.sum("items").alias("items"), F.round(F.max("best"), 6).alias("best"), F.round(F.sum("total"), 3).alias("total"))
)
query(
    "recommend_items",
    """SELECT request_id, CAST(position AS INTEGER) AS position, content_kind, content_id, school_id, station_id AS primary_station_id, round(score, 6) AS score, fallback_stage FROM x_result""",
)(
    lambda m: m.batch.items().select(
        "request_id", "position", "content_kind", "content_id", "school_id", "primary_station_id", F.round("score", 6).alias("score"), "fallback_stage"
    )
)
query(
    "diversity_summary",
    """SELECT c.request_id, count(DISTINCT q.r) AS selected_count, coalesce(any_value(s.same_school), 0) AS skipped_same_school, coalesce(any_value(s.same_group), 0) AS skipped_same_group,
            coalesce(any_value(s.kind_school), 0) AS skipped_kind_school, coalesce(any_value(s.kind_event), 0) AS skipped_kind_event
       FROM x_caps c JOIN x_picks q ON q.request_id = c.request_id LEFT JOIN x_skipped s ON s.request_id = c.request_id GROUP BY 1""",
)(
    lambda m: m.batch.headers().select(
        "request_id", F.col("selected_count").cast("long").alias("selected_count"), "skipped_same_school", "skipped_same_group", "skipped_kind_school", "skipped_kind_event"
    )
)
query(
    "answer_limits",
    """SELECT DISTINCT c.request_id, CAST(c.cap AS INTEGER) AS effective_limit, p.n5 >= 256 AS candidates_cut FROM x_caps c JOIN x_plan p ON p.request_id = c.request_id""",
)(lambda m: m.batch.headers().select("request_id", "effective_limit", "candidates_cut"))
