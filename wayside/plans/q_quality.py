"""Queries over data quality and operations reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayside.operators import quality
from wayside.plans.registry import extra_tables, query

JOBS_AS_OF = "1998-06-01 00:00:00"
_C = F.col


def import_runs(m):
    o = m.source("orders")
    return o.select(
        _C("o_orderkey").alias("id"),
        F.when(_C("o_orderpriority") == "5-LOW", "event-csv").otherwise(F.concat(F.lit("feed-"), F.substring("o_orderpriority", 1, 1))).alias("source_id"),
        F.when(_C("o_orderstatus") == "F", "succeeded").when(_C("o_orderstatus") == "O", "running").otherwise("failed").alias("status"),
        F.floor(_C("o_totalprice") / 10000.0).cast("long").alias("total_rows"),
        _C("o_orderdate").cast("timestamp_ntz").alias("started_at"),
    )


def import_reports(m):
    li = m.source("lineitem")
    return li.select(
        (_C("l_orderkey") * 100_000_000 + _C("l_partkey") * 1000 + _C("l_suppkey") * 8 + _C("l_linenumber")).alias("id"),
        _C("l_orderkey").alias("import_run_id"),
        F.when(_C("l_returnflag") == "A", "warn").when(_C("l_returnflag") == "R", "error").otherwise("info").alias("level"),
        F.when(_C("l_linestatus") == "O", "event_csv_deactivated_stale_rows").otherwise("event_csv_imported").alias("code"),
        _C("l_quantity").cast("long").alias("row_count"),
        _C("l_shipdate").cast("timestamp_ntz").alias("created_at"),
    )


def jobs(m):
    o = m.source("orders")
    at = _C("o_orderdate").cast("timestamp_ntz")
    return o.select(
        _C("o_orderkey").alias("id"), _C("o_orderpriority").alias("job_type"),
        F.when(_C("o_orderstatus") == "F", "failed").when(_C("o_orderstatus") == "O", "running").otherwise("queued").alias("status"),
        at.alias("locked_at"), at.alias("run_after"), (at + F.expr("INTERVAL 1 DAY")).alias("updated_at"),
    )


def manifests(m):
    s = m.source("supplier")
    sid = F.concat(F.lit("s"), _C("s_suppkey").cast("string"))
    inner = F.when(_C("s_suppkey") % 10 == 0, F.lit('{"name":"x"}')).otherwise(F.concat(F.lit('{"source_id":"'), sid, F.lit('"}')))
    return s.select(F.concat(F.lit("manifests/"), sid).alias("manifest_path"), sid.alias("source_id"), inner.alias("manifest_json"))


def refreshed(df, count):
    return df.withColumn("refreshed_at", F.expr(f"timestamp_ntz'2024-01-20 00:00:00' + make_dt_interval(cast({count} % 30 as int))"))


def refreshed_popularity(m):
    return refreshed(m.popularity, "total_events")


def refreshed_areas(m):
    return refreshed(m.area_affinity, "event_count")


def as_of():
    return F.lit(JOBS_AS_OF).cast("timestamp_ntz")


extra_tables(
    m_import_runs="""SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '5-LOW' THEN 'event-csv' ELSE 'feed-' || substr(o_orderpriority, 1, 1) END AS source_id,
            CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
            CAST(floor(o_totalprice / 10000.0e0) AS BIGINT) AS total_rows, o_orderdate AS started_at FROM orders""",
    m_import_reports="""SELECT l_orderkey * 100000000 + l_partkey * 1000 + l_suppkey * 8 + l_linenumber AS id, l_orderkey AS import_run_id, CASE l_returnflag WHEN 'A' THEN 'warn' WHEN 'R' THEN 'error' ELSE 'info' END AS level,
            CASE WHEN l_linestatus = 'O' THEN 'event_csv_deactivated_stale_rows' ELSE 'event_csv_imported' END AS code,
            CAST(l_quantity AS BIGINT) AS row_count, l_shipdate AS created_at FROM lineitem""",
    m_jobs="""SELECT o_orderkey AS id, o_orderpriority AS job_type, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'queued' END AS status,
            o_orderdate AS locked_at, o_orderdate AS run_after, o_orderdate + INTERVAL 1 DAY AS updated_at FROM orders""",
    m_manifests="""SELECT 'manifests/s' || s_suppkey AS manifest_path, 's' || s_suppkey AS source_id,
            CASE WHEN s_suppkey % 10 = 0 THEN '{"name":"x"}' ELSE '{"source_id":"s' || s_suppkey || '"}' END AS manifest_json FROM supplier""",
    m_pop_refreshed="SELECT *, TIMESTAMP '2024-01-20 00:00:00' + to_days(CAST(total_events % 30 AS INTEGER)) AS refreshed_at FROM m_popularity",
    m_area_refreshed="SELECT *, TIMESTAMP '2024-01-20 00:00:00' + to_days(CAST(event_count % 30 AS INTEGER)) AS refreshed_at FROM m_area_affinity",
)

_AS_OF = f"TIMESTAMP '{JOBS_AS_OF}'"

query(
    "relation_counts",
    """SELECT 'schools' AS relation, count(*) AS row_count FROM m_schools UNION ALL SELECT 'stations', count(*) FROM m_stations
       UNION ALL SELECT 'school_station_links', count(*) FROM m_links UNION ALL SELECT 'events_total', count(*) FROM m_events
       UNION ALL SELECT 'events_active', count(*) FROM m_events WHERE is_active
       UNION ALL SELECT 'event_csv_active', count(*) FROM m_events WHERE is_active AND source_type = 'event_csv'""",
)(lambda m: quality.relation_counts(m.schools, m.stations, m.links, m.events))


def more_schools(m):
    """All schools, and each once more under an id and an area that nothing refers to."""
    bare = m.schools.withColumns({"id": F.concat(F.lit("bare_"), _C("id")), "area": F.concat(F.lit("bare "), _C("area"))})
    return m.schools.unionByName(bare)


query(
    "schools_without_active_events",
    """SELECT s.id, s.name, s.area, count(e.id) FILTER (WHERE e.is_active) AS active_events, count(e.id) FILTER (WHERE NOT e.is_active) AS inactive_events
       FROM x_schools s LEFT JOIN m_events e ON e.school_id = s.id GROUP BY 1, 2, 3 HAVING count(e.id) FILTER (WHERE e.is_active) = 0""",
)(lambda m: quality.schools_without_active_events(more_schools(m), m.events))
extra_tables(x_schools="SELECT * FROM m_schools UNION ALL SELECT * REPLACE ('bare_' || id AS id, 'bare ' || area AS area) FROM m_schools")
query(
    "schools_without_links",
    "SELECT id, name, area FROM x_schools s WHERE NOT EXISTS (SELECT 1 FROM m_links l WHERE l.school_id = s.id)",
)(lambda m: quality.schools_without_links(more_schools(m), m.links))
query("invalid_link_metrics", "SELECT school_id, station_id FROM m_links WHERE walking_minutes - 5 <= 0 OR distance_meters < 0 OR hop_distance - 1 < 0")(
    lambda m: quality.invalid_link_metrics(
        m.links.withColumns({"walking_minutes": _C("walking_minutes") - 5, "hop_distance": _C("hop_distance") - 1})
    ).select("school_id", "station_id")
)
query("missing_popularity", "SELECT id, name FROM x_schools WHERE id NOT IN (SELECT school_id FROM m_popularity)")(
    lambda m: quality.missing_popularity(more_schools(m), m.popularity)
)
query("missing_area_snapshots", "SELECT DISTINCT area FROM x_schools WHERE area NOT IN (SELECT area FROM m_area_affinity)")(
    lambda m: quality.missing_area_snapshots(more_schools(m), m.area_affinity)
)
query("stale_popularity", "SELECT school_id FROM m_pop_refreshed WHERE refreshed_at < (SELECT max(occurred_at) FROM m_user_events)")(
    lambda m: quality.stale_snapshots(refreshed_popularity(m), m.user_events).select("school_id")
)
query("stale_area_snapshots", "SELECT area FROM m_area_refreshed WHERE refreshed_at < (SELECT max(occurred_at) FROM m_user_events)")(
    lambda m: quality.stale_snapshots(refreshed_areas(m), m.user_events).select("area")
)
query("events_without_source_key", "SELECT id, source_type FROM m_events WHERE source_type <> 'seed' AND coalesce(source_key, '') = ''")(
    lambda m: quality.events_without_source_key(m.events).select("id", "source_type")
)
query(
    "duplicate_active_events",
    """SELECT source_type, coalesce(source_key, '') AS source_key, school_id, title, starts_at, count(*) AS duplicate_count FROM m_events_flat
       GROUP BY ALL HAVING count(*) > 1""",
)(lambda m: quality.duplicate_active_events(m.events.withColumn("starts_at", F.date_trunc("year", "starts_at").cast("timestamp_ntz"))))
extra_tables(m_events_flat="SELECT source_type, source_key, school_id, title, CAST(date_trunc('year', starts_at) AS TIMESTAMP) AS starts_at FROM m_events WHERE is_active")
query(
    "manifest_mismatches",
    "SELECT manifest_path, source_id, json_extract_string(manifest_json, '$.source_id') AS manifest_json_source_id FROM m_manifests WHERE coalesce(json_extract_string(manifest_json, '$.source_id'), '') <> source_id",
)(lambda m: quality.manifest_mismatches(manifests(m)).select("manifest_path", "source_id", "manifest_json_source_id"))
query(
    "imported_but_inactive",
    """SELECT * FROM (SELECT (SELECT count(*) FROM m_import_runs WHERE source_id = 'event-csv' AND status = 'succeeded') AS succeeded_runs,
        (SELECT count(*) FROM m_events WHERE source_type = 'event_csv' AND source_key = 'event-csv' AND is_active) AS active_rows) WHERE succeeded_runs > 0 AND active_rows = 0""",
)(lambda m: quality.imported_but_inactive(import_runs(m), m.events))
query(
    "heavy_deactivation",
    """SELECT r.source_id, r.id AS import_run_id, r.total_rows, CAST(d.n AS BIGINT) AS deactivated_rows FROM m_import_runs r
       JOIN (SELECT source_id, max(id) AS id FROM m_import_runs WHERE status = 'succeeded' GROUP BY 1) l ON l.id = r.id
       JOIN (SELECT import_run_id, sum(row_count) AS n FROM m_import_reports WHERE code = 'event_csv_deactivated_stale_rows' GROUP BY 1) d ON d.import_run_id = r.id
       WHERE d.n > greatest(r.total_rows, 1)""",
)(lambda m: quality.heavy_deactivation(import_runs(m), import_reports(m)).select("source_id", "import_run_id", "total_rows", "deactivated_rows"))
query(
    "recent_import_warnings",
    f"""SELECT r.source_id, p.level, p.code, count(*) AS reports, CAST(sum(p.row_count) AS BIGINT) AS rows, max(p.created_at) AS newest FROM m_import_reports p
        JOIN m_import_runs r ON r.id = p.import_run_id WHERE p.level IN ('warn', 'error') AND p.created_at >= {_AS_OF} - INTERVAL 7 DAY GROUP BY 1, 2, 3""",
)(
    lambda m: quality.recent_warnings(import_runs(m), import_reports(m), as_of())
    .groupBy("source_id", "level", "code")
    .agg(F.count(F.lit(1)).alias("reports"), F.sum("row_count").alias("rows"), F.max("created_at").alias("newest"))
)
query("failed_jobs", "SELECT id, job_type, updated_at FROM m_jobs WHERE status = 'failed'")(
    lambda m: quality.failed_jobs(jobs(m)).select("id", "job_type", "updated_at")
)
query(
    "job_worklist",
    """SELECT id, job_type, status, CASE status WHEN 'running' THEN 0 ELSE 1 END AS place, coalesce(locked_at, run_after) AS since
       FROM m_jobs WHERE status IN ('running', 'failed')""",
)(lambda m: quality.job_worklist(jobs(m)).select("id", "job_type", "status", "place", "since"))
query("stale_running_jobs", f"SELECT id, locked_at FROM m_jobs WHERE status = 'running' AND locked_at < {_AS_OF} - INTERVAL 15 MINUTE")(
    lambda m: quality.stale_running_jobs(jobs(m), as_of()).select("id", "locked_at")
)
query("overdue_jobs", f"SELECT id, run_after FROM m_jobs WHERE status = 'queued' AND run_after < {_AS_OF} - INTERVAL 15 MINUTE")(
    lambda m: quality.overdue_jobs(jobs(m), as_of()).select("id", "run_after")
)
query(
    "queue_pressure",
    "SELECT job_type, status, count(*) AS job_count, min(run_after) AS oldest_run_after, max(updated_at) AS latest_update FROM m_jobs GROUP BY 1, 2",
)(lambda m: quality.queue_pressure(jobs(m)))
query(
    "snapshot_coverage",
    """SELECT 'area_affinity' AS snapshot, count(*) AS row_count, max(refreshed_at) AS newest_refresh FROM m_area_refreshed
       UNION ALL SELECT 'popularity', count(*), max(refreshed_at) FROM m_pop_refreshed
       UNION ALL SELECT 'user_affinity', count(*), max(TIMESTAMP '2024-01-20 00:00:00' + to_days(CAST(event_count % 30 AS INTEGER))) FROM m_user_affinity
       UNION ALL SELECT 'schools', count(*), NULL FROM m_schools""",
)(
    lambda m: quality.snapshot_coverage(
        {"popularity": refreshed_popularity(m), "area_affinity": refreshed_areas(m), "user_affinity": refreshed(m.user_affinity, "event_count"), "schools": m.schools}
    )
)
query(
    "latest_import_runs",
    """SELECT source_id, id, status, total_rows, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id DESC) AS rank FROM m_import_runs) WHERE rank <= 5""",
)(lambda m: quality.latest_per_source(import_runs(m), "source_id", [_C("id").desc()], 5).select("source_id", "id", "status", "total_rows", "rank"))

query(
    "latest_import_reports",
    """SELECT p.import_run_id, p.level, p.code, p.row_count FROM m_import_reports p JOIN m_import_runs r ON r.id = p.import_run_id
       WHERE r.source_id = 'event-csv' ORDER BY p.id DESC LIMIT 10""",
)(
    lambda m: quality.latest(
        import_reports(m).join(import_runs(m).where("source_id = 'event-csv'").select(_C("id").alias("import_run_id")), "import_run_id", "left_semi"),
        [_C("id").desc()],
        10,
    ).select("import_run_id", "level", "code", "row_count")
)
query(
    "latest_event_rows",
    """SELECT id, school_id, title, event_category, is_active, source_key FROM m_events WHERE source_type = 'event_csv' ORDER BY updated_at DESC, id LIMIT 20""",
)(
    lambda m: quality.latest(m.events.where("source_type = 'event_csv'"), [_C("updated_at").desc(), _C("id")], 20).select(
        "id", "school_id", "title", "event_category", "is_active", "source_key"
    )
)


def _checks(m):
    events = m.events
    return {
        "schools without active events": quality.schools_without_active_events(m.schools, events),
        "schools without station links": quality.schools_without_links(m.schools, m.links),
        "invalid station link metrics": quality.invalid_link_metrics(m.links),
        "missing popularity snapshots": quality.missing_popularity(m.schools, m.popularity),
        "missing area snapshots": quality.missing_area_snapshots(m.schools, m.area_affinity),
        "stale popularity snapshots": quality.stale_snapshots(refreshed_popularity(m), m.user_events),
        "stale area snapshots": quality.stale_snapshots(refreshed_areas(m), m.user_events),
        "events without source key": quality.events_without_source_key(events),
        "duplicate active events": quality.duplicate_active_events(events),
        "manifest mismatches": quality.manifest_mismatches(manifests(m)),
        "imported but inactive": quality.imported_but_inactive(import_runs(m), events),
        "heavy deactivation": quality.heavy_deactivation(import_runs(m), import_reports(m)),
        "recent import warnings": quality.recent_warnings(import_runs(m), import_reports(m), as_of()),
        "failed jobs": quality.failed_jobs(jobs(m)),
        "stale running jobs": quality.stale_running_jobs(jobs(m), as_of()),
        "overdue jobs": quality.overdue_jobs(jobs(m), as_of()),
    }


query(
    "guardrail_summary",
    f"""SELECT "check", "count", CASE WHEN "count" = 0 THEN 'ok' ELSE 'review' END AS verdict FROM (
        SELECT 'schools without active events' AS "check", count(*) AS "count" FROM m_schools WHERE id NOT IN (SELECT school_id FROM m_events WHERE is_active)
        UNION ALL SELECT 'schools without station links', count(*) FROM m_schools WHERE id NOT IN (SELECT school_id FROM m_links)
        UNION ALL SELECT 'invalid station link metrics', count(*) FROM m_links WHERE walking_minutes <= 0 OR distance_meters < 0 OR hop_distance < 0
        UNION ALL SELECT 'missing popularity snapshots', count(*) FROM m_schools WHERE id NOT IN (SELECT school_id FROM m_popularity)
        UNION ALL SELECT 'missing area snapshots', count(DISTINCT area) FROM m_schools WHERE area NOT IN (SELECT area FROM m_area_affinity)
        UNION ALL SELECT 'stale popularity snapshots', count(*) FROM m_pop_refreshed WHERE refreshed_at < (SELECT max(occurred_at) FROM m_user_events)
        UNION ALL SELECT 'stale area snapshots', count(*) FROM m_area_refreshed WHERE refreshed_at < (SELECT max(occurred_at) FROM m_user_events)
        UNION ALL SELECT 'events without source key', count(*) FROM m_events WHERE source_type <> 'seed' AND coalesce(source_key, '') = ''
        UNION ALL SELECT 'duplicate active events', count(*) FROM (SELECT 1 FROM m_events WHERE is_active GROUP BY source_type, coalesce(source_key, ''), school_id, title, starts_at HAVING count(*) > 1)
        UNION ALL SELECT 'manifest mismatches', count(*) FROM m_manifests WHERE coalesce(json_extract_string(manifest_json, '$.source_id'), '') <> source_id
        UNION ALL SELECT 'imported but inactive', CASE WHEN (SELECT count(*) FROM m_import_runs WHERE source_id = 'event-csv' AND status = 'succeeded') > 0
            AND (SELECT count(*) FROM m_events WHERE source_type = 'event_csv' AND source_key = 'event-csv' AND is_active) = 0 THEN 1 ELSE 0 END
        UNION ALL SELECT 'heavy deactivation', count(*) FROM m_import_runs r JOIN (SELECT max(id) AS id FROM m_import_runs WHERE status = 'succeeded' GROUP BY source_id) l ON l.id = r.id
            WHERE (SELECT sum(row_count) FROM m_import_reports d WHERE d.import_run_id = r.id AND d.code = 'event_csv_deactivated_stale_rows') > greatest(r.total_rows, 1)
        UNION ALL SELECT 'recent import warnings', count(*) FROM m_import_reports p JOIN m_import_runs r ON r.id = p.import_run_id WHERE level IN ('warn', 'error') AND created_at >= {_AS_OF} - INTERVAL 7 DAY
        UNION ALL SELECT 'failed jobs', count(*) FROM m_jobs WHERE status = 'failed'
        UNION ALL SELECT 'stale running jobs', count(*) FROM m_jobs WHERE status = 'running' AND locked_at < {_AS_OF} - INTERVAL 15 MINUTE
        UNION ALL SELECT 'overdue jobs', count(*) FROM m_jobs WHERE status = 'queued' AND run_after < {_AS_OF} - INTERVAL 15 MINUTE)""",
)(lambda m: quality.guardrail_summary(_checks(m)))
