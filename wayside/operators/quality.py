"""Data-quality and operations checks.

Every check returns all offending rows; ``guardrail_summary`` counts them in
one job.  ``as_of`` stands for the current time, so results can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LOCK_MINUTES = 15
REPORT_DAYS = 7
EVENT_FEED = "event-csv"


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def relation_counts(schools: DataFrame, stations: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """Row counts of six relations; the events table is read once."""
    active = F.col("is_active")
    ev = events.agg(
        F.count(F.lit(1)).alias("events_total"),
        F.count_if(active).alias("events_active"),
        F.count_if(active & (F.col("source_type") == "event_csv")).alias("event_csv_active"),
    )
    names = ["events_total", "events_active", "event_csv_active"]
    ev = ev.select(F.explode(F.array(*[F.struct(F.lit(n).alias("relation"), F.col(n).alias("row_count")) for n in names])).alias("r")).select("r.*")
    dims = {"schools": schools, "stations": stations, "school_station_links": links}
    return _union([ev, *[_count(df).select(F.lit(n).alias("relation"), "row_count") for n, df in dims.items()]])


def schools_without_active_events(schools: DataFrame, events: DataFrame) -> DataFrame:
    per = events.groupBy(F.col("school_id").alias("id")).agg(
        F.count_if("is_active").alias("active_events"), F.count_if(~F.col("is_active")).alias("inactive_events")
    )
    zero = F.lit(0).cast("long")
    rows = schools.select("id", "name", "area").join(per, "id", "left")
    rows = rows.withColumns({n: F.coalesce(n, zero) for n in ("active_events", "inactive_events")})
    return rows.where(F.col("active_events") == 0)


def schools_without_links(schools: DataFrame, links: DataFrame) -> DataFrame:
    linked = links.select(F.col("school_id").alias("id")).distinct()
    return schools.select("id", "name", "area").join(linked, "id", "left_anti")


def invalid_link_metrics(links: DataFrame) -> DataFrame:
    return links.where((F.col("walking_minutes") <= 0) | (F.col("distance_meters") < 0) | (F.col("hop_distance") < 0))


def missing_popularity(schools: DataFrame, popularity: DataFrame) -> DataFrame:
    return schools.select("id", "name").join(popularity.select(F.col("school_id").alias("id")), "id", "left_anti")


def missing_area_snapshots(schools: DataFrame, area_affinity: DataFrame) -> DataFrame:
    return schools.select("area").distinct().join(area_affinity.select("area"), "area", "left_anti")


def stale_snapshots(snapshot: DataFrame, log: DataFrame, stamp: str = "occurred_at") -> DataFrame:
    """Snapshot rows older than the newest log row (a one-row scalar subquery)."""
    newest = log.agg(F.max(stamp).alias("t")).scalar()
    return snapshot.where(F.col("refreshed_at") < newest)


def events_without_source_key(events: DataFrame) -> DataFrame:
    blank = F.col("source_key").isNull() | (F.col("source_key") == "")
    return events.where((F.col("source_type") != "seed") & blank)


def duplicate_active_events(events: DataFrame) -> DataFrame:
    """Natural keys used by more than one active event."""
    key = F.coalesce("source_key", F.lit("")).alias("source_key")
    groups = events.where("is_active").groupBy("source_type", key, "school_id", "title", "starts_at")
    return groups.agg(F.count(F.lit(1)).alias("duplicate_count")).where(F.col("duplicate_count") > 1)


def manifest_mismatches(manifests: DataFrame) -> DataFrame:
    inner = F.get_json_object("manifest_json", "$.source_id")
    return manifests.withColumn("manifest_json_source_id", inner).where(F.coalesce(inner, F.lit("")) != F.col("source_id"))


def imported_but_inactive(runs: DataFrame, events: DataFrame, source_id: str = EVENT_FEED, source_type: str = "event_csv") -> DataFrame:
    """One row when the feed was imported but no event of it is active."""
    done = runs.where((F.col("source_id") == source_id) & (F.col("status") == "succeeded"))
    live = events.where((F.col("source_type") == source_type) & (F.col("source_key") == source_id) & F.col("is_active"))
    facts = done.agg(F.count(F.lit(1)).alias("succeeded_runs")).withColumn("active_rows", _count(live).scalar())
    return facts.where((F.col("succeeded_runs") > 0) & (F.col("active_rows") == 0))


def heavy_deactivation(runs: DataFrame, reports: DataFrame, code: str = "event_csv_deactivated_stale_rows") -> DataFrame:
    """Per source: the latest succeeded run, when it deactivated more than it read."""
    latest = runs.where(F.col("status") == "succeeded").groupBy("source_id").agg(
        F.max("id").alias("import_run_id"), F.max_by("total_rows", "id").alias("total_rows")
    )
    off = reports.where(F.col("code") == code).groupBy("import_run_id").agg(F.sum("row_count").alias("deactivated_rows"))
    rows = latest.join(off, "import_run_id")
    return rows.where(F.col("deactivated_rows") > F.greatest(F.coalesce("total_rows", F.lit(0).cast("long")), F.lit(1).cast("long")))


def recent_warnings(runs: DataFrame, reports: DataFrame, as_of: Column) -> DataFrame:
    """Warning and error reports of the last seven days."""
    fresh = reports.where(F.col("level").isin("warn", "error") & (F.col("created_at") >= as_of - F.expr(f"INTERVAL {REPORT_DAYS} DAYS")))
    return fresh.join(runs.select(F.col("id").alias("import_run_id"), "source_id"), "import_run_id")


def failed_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status") == "failed")


def job_worklist(jobs: DataFrame) -> DataFrame:
    """All running and failed jobs with what orders them: running first, then by lock time (or the time they were due), then by id."""
    rows = jobs.where(F.col("status").isin("running", "failed"))
    return rows.withColumns({"place": F.when(F.col("status") == "running", 0).otherwise(1), "since": F.coalesce("locked_at", "run_after")})


def _minutes_ago(as_of: Column) -> Column:
    return as_of - F.expr(f"INTERVAL {LOCK_MINUTES} MINUTES")


def stale_running_jobs(jobs: DataFrame, as_of: Column) -> DataFrame:
    return jobs.where((F.col("status") == "running") & (F.col("locked_at") < _minutes_ago(as_of)))


def overdue_jobs(jobs: DataFrame, as_of: Column) -> DataFrame:
    return jobs.where((F.col("status") == "queued") & (F.col("run_after") < _minutes_ago(as_of)))


def queue_pressure(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("job_type", "status").agg(
        F.count(F.lit(1)).alias("job_count"), F.min("run_after").alias("oldest_run_after"), F.max("updated_at").alias("latest_update")
    )


def snapshot_coverage(snapshots: dict[str, DataFrame]) -> DataFrame:
    """Rows and newest refresh of each snapshot table; a table without refresh times, such as the schools, has its rows only."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count"), (F.max("refreshed_at") if "refreshed_at" in df.columns else F.lit(None).cast("timestamp_ntz")).alias("newest_refresh")).withColumn(
            "snapshot", F.lit(name)
        )
        for name, df in sorted(snapshots.items())
    ]
    return _union(parts).select("snapshot", "row_count", "newest_refresh")


def latest_per_source(df: DataFrame, source: str, order: list[Column], n: int) -> DataFrame:
    """The newest ``n`` rows of every source."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(source).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def latest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def guardrail_summary(checks: dict[str, DataFrame]) -> DataFrame:
    """Name, count and ok/review for every check."""
    rows = _union([_count(df).select(F.lit(name).alias("check"), F.col("row_count").alias("count")) for name, df in checks.items()])
    return rows.withColumn("verdict", F.when(F.col("count") == 0, "ok").otherwise("review"))
