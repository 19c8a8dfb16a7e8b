"""Queries over dimensions, links and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayside.operators import links, snapshots
from wayside.plans.registry import extra_tables, query
from wayside.plans.testmap import sphere_sql

query("derive_links", "SELECT * FROM m_derived_links")(lambda m: m.derived_links)

query(
    "unlinked_schools",
    """SELECT g.* FROM (SELECT * FROM m_school_geo UNION ALL SELECT * REPLACE ('far_' || school_id AS school_id) FROM m_school_geo) g
       WHERE NOT EXISTS (SELECT 1 FROM m_links l WHERE l.school_id = g.school_id)""",
)(lambda m: links.unlinked_schools(m.school_geo.unionByName(m.school_geo.withColumn("school_id", F.concat(F.lit("far_"), "school_id"))), m.links))


@query(
    "refresh_links",
    """SELECT school_id, station_id, walking_minutes, distance_meters, hop_distance, line_name FROM m_derived_links
       UNION ALL
       SELECT 'x' || school_id, station_id, walking_minutes, distance_meters, hop_distance, line_name FROM m_links""",
)
def _refresh_links(m):
    foreign = m.links.withColumn("school_id", F.concat(F.lit("x"), "school_id"))
    return links.refresh_links(m.links.unionByName(foreign), m.derived_links, m.school_geo)


@query(
    "within_distance_join",
    f"""SELECT school_id, station_id, round(d, 2) AS metres FROM (
        SELECT g.school_id, s.id AS station_id,
            {sphere_sql("g.latitude", "g.longitude", "s.latitude", "s.longitude")} AS d
        FROM m_school_geo g, m_stations s) WHERE d <= 1500""",
)
def _within(m):
    pairs = links.within_join(m.school_geo, m.stations.select(F.col("id").alias("station_id"), "latitude", "longitude"), 1500.0, "sphere")
    return pairs.select("school_id", "station_id", F.round("distance_m", 2).alias("metres"))


@query(
    "link_distances",
    f"""SELECT l.school_id, l.station_id,
            round({sphere_sql("g.latitude", "g.longitude", "s.latitude", "s.longitude")}, 2) AS sphere_m,
            l.distance_meters AS ellipsoid_m
        FROM m_links l JOIN m_school_geo g ON g.school_id = l.school_id JOIN m_stations s ON s.id = l.station_id""",
)
def _link_distances(m):
    a = m.school_geo.withColumnsRenamed({"latitude": "from_latitude", "longitude": "from_longitude"})
    b = m.stations.select(F.col("id").alias("station_id"), F.col("latitude").alias("to_latitude"), F.col("longitude").alias("to_longitude"))
    pairs = m.links.select("school_id", "station_id").join(a, "school_id").join(b, "station_id")
    sphere = links.with_distance(pairs, "sphere").withColumnRenamed("distance_m", "sphere_raw")
    both = links.with_distance(sphere, "ellipsoid")
    return both.select(
        "school_id", "station_id", F.round("sphere_raw", 2).alias("sphere_m"), F.rint("distance_m").cast("int").alias("ellipsoid_m")
    )


# weight of a log row by kind; a search near a place weighs on the place and, less, on its area
_KINDS = {"school_view": 1.0, "event_view": 0.75, "school_save": 2.0, "apply_click": 2.5, "share": 1.5}
_SEARCH_PLACE, _SEARCH_AREA = 0.4, 0.2


def _counted(prefix: str = "") -> str:
    return ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {prefix}{k}" for k in _KINDS)


def _zeroed(prefix: str = "") -> str:
    return ", ".join(f"coalesce({prefix}{k}, 0) AS {k}_count" for k in _KINDS)


_SUMMED = " + ".join(f"{k}_count" for k in _KINDS)
_WEIGHED = " + ".join(f"{k}_count * {w}e0" for k, w in _KINDS.items())


def _share(value: str, of: str = "") -> str:
    """A value as a part of the largest one, 0 where that is 0."""
    return f"coalesce({value} / nullif(greatest(max({value}) OVER ({of}), 0.0e0), 0.0e0), 0.0e0)"


extra_tables(
    m_log_by_school=f"SELECT school_id, {_counted()} FROM m_user_events GROUP BY school_id",
    m_searches_by_station="SELECT target_station_id AS station_id, count(*) AS searches FROM m_user_events WHERE event_type = 'search_execute' GROUP BY ALL",
    m_school_counts=f"""SELECT id AS school_id, area, {_zeroed("own.")}, CAST(coalesce(near.searches, 0) AS BIGINT) AS search_execute_count
        FROM m_schools LEFT JOIN m_log_by_school own ON own.school_id = id
        LEFT JOIN (SELECT school_id, sum(searches) AS searches FROM m_links JOIN m_searches_by_station USING (station_id) GROUP BY school_id) near ON near.school_id = id""",
    m_popularity=f"""SELECT school_id, {_share("score")} AS popularity_score, {_SUMMED} + search_execute_count AS total_events,
            school_view_count, school_save_count, event_view_count, apply_click_count, share_count, search_execute_count
        FROM (SELECT *, {_WEIGHED} + search_execute_count * {_SEARCH_PLACE}e0 AS score FROM m_school_counts)""",
    m_area_searches="""SELECT area, CAST(sum(searches) AS BIGINT) AS searches
        FROM (SELECT DISTINCT area, station_id FROM m_links JOIN m_schools ON id = school_id) JOIN m_searches_by_station USING (station_id) GROUP BY area""",
    m_area_affinity=f"""SELECT area, {_share("score")} AS affinity_score, CAST(n + searches AS BIGINT) AS event_count, searches AS search_execute_count
        FROM (SELECT area, sum({_SUMMED}) AS n, any_value(coalesce(s.searches, 0)) AS searches, sum({_WEIGHED}) + any_value(coalesce(s.searches, 0)) * {_SEARCH_AREA}e0 AS score
              FROM m_school_counts LEFT JOIN m_area_searches s USING (area) GROUP BY area)""",
    m_user_affinity=f"""SELECT user_id, school_id, {_share("score", "PARTITION BY user_id")} AS affinity_score, event_count
        FROM (SELECT user_id, school_id, {_SUMMED} AS event_count, {_WEIGHED} AS score
              FROM (SELECT user_id, school_id, {", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}_count" for k in _KINDS)}
                    FROM m_user_events WHERE school_id IS NOT NULL GROUP BY ALL) WHERE {_SUMMED} > 0)""",
)

query("popularity_snapshot", "SELECT * REPLACE (round(popularity_score, 9) AS popularity_score) FROM m_popularity")(
    lambda m: m.popularity.withColumn("popularity_score", F.round("popularity_score", 9))
)
query("area_affinity_snapshot", "SELECT * REPLACE (round(affinity_score, 9) AS affinity_score) FROM m_area_affinity")(
    lambda m: m.area_affinity.withColumn("affinity_score", F.round("affinity_score", 9))
)
query("user_affinity_snapshot", "SELECT * REPLACE (round(affinity_score, 9) AS affinity_score) FROM m_user_affinity")(
    lambda m: m.user_affinity.withColumn("affinity_score", F.round("affinity_score", 9))
)


@query(
    "user_affinity_for_searchers",
    """SELECT * REPLACE (round(affinity_score, 9) AS affinity_score) FROM m_user_affinity
       WHERE user_id IN (SELECT user_id FROM m_user_events WHERE event_type = 'share')""",
)
def _affinity_subset(m):
    users = m.user_events.where("event_type = 'share'").select("user_id")
    return snapshots.user_affinity(m.log_counts, users).withColumn("affinity_score", F.round("affinity_score", 9))


@query(
    "prune_snapshots",
    """SELECT school_id, total_events FROM m_popularity""",
)
def _prune(m):
    # every snapshot row once more for a school that is gone
    stored = m.popularity.unionByName(m.popularity.withColumn("school_id", F.concat(F.lit("gone_"), "school_id")))
    return snapshots.prune(stored, m.schools.select(F.col("id").alias("school_id")), "school_id").select("school_id", "total_events")


@query(
    "refresh_snapshot_counts",
    """SELECT 'area_affinity_snapshots' AS snapshot, count(*) AS rows FROM m_area_affinity
       UNION ALL SELECT 'popularity_snapshots', count(*) FROM m_popularity
       UNION ALL SELECT 'user_affinity_snapshots', count(*) FROM m_user_affinity""",
)
def _refresh_counts(m):
    return snapshots.refresh_counts(snapshots.refresh_snapshots(m.schools, m.links, m.user_events))
