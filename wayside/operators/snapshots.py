"""Behaviour snapshots: popularity, area affinity and user affinity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayside.config import DEFAULT_CONFIG, EVENT_WEIGHTS, RankingConfig
from wayside.session import settle


COUNTS = "user_id string, school_id string, station_id string, event_type string, n long"
_KEYS = ["user_id", "school_id", "station_id", "event_type"]
SEARCH = "search_execute"


def log_counts(log: DataFrame) -> DataFrame:
    """All that the snapshots need of a log: rows per (user, school, kind), and searches per station.

    One scan and one partial aggregate.  Counts add up, so those of parts of a
    log are merged with ``merge_counts``, in any order.
    """
    search = F.col("event_type") == SEARCH
    rows = log.where((F.col("event_type").isin(*EVENT_WEIGHTS) & F.col("school_id").isNotNull()) | (search & F.col("target_station_id").isNotNull()))
    keyed = rows.select(
        F.when(~search, F.col("user_id")).alias("user_id"), F.when(~search, F.col("school_id")).alias("school_id"),
        F.when(search, F.col("target_station_id")).alias("station_id"), "event_type",
    )
    return keyed.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"))


def merge_counts(*parts: DataFrame) -> DataFrame:
    """The counts of several parts of a log as one."""
    return reduce(DataFrame.unionByName, parts).groupBy(*_KEYS).agg(F.sum("n").alias("n"))


def _weighed() -> Column:
    """Weight of a row of counts; the weights are multiples of a quarter, so sums of products are exact."""
    out = F.lit(0.0)
    for kind, weight in EVENT_WEIGHTS.items():
        out = F.when(F.col("event_type") == kind, F.lit(weight)).otherwise(out)
    return out * F.col("n")


def _scored(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("event_type") != SEARCH)


def _per_school(counts: DataFrame) -> DataFrame:
    kinds = ("school_view", "school_save", "event_view", "apply_click", "share")
    of = [F.coalesce(F.sum(F.when(F.col("event_type") == k, F.col("n"))), F.lit(0).cast("long")).alias(f"{k}_count") for k in kinds]
    return _scored(counts).groupBy("school_id").agg(F.sum(_weighed()).alias("raw"), F.sum("n").alias("n"), *of)


def _searches_per_station(counts: DataFrame) -> DataFrame:
    """Searches are counted per station first, so a busy station is one row."""
    return counts.where(F.col("event_type") == SEARCH).groupBy("station_id").agg(F.sum("n").alias("searches"))


def _over_max(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Divide by the largest raw value (a one-row scalar subquery)."""
    top = df.agg(F.max(raw).alias("top")).scalar()
    return df.withColumn(out, F.when(top > 0, F.col(raw) / top).otherwise(F.lit(0.0)))


def popularity(schools: DataFrame, links: DataFrame, counts: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """Popularity per school from ``log_counts``; schools without behaviour stay, at zero."""
    searched = (
        links.select("school_id", "station_id")
        .join(_searches_per_station(counts), "station_id")
        .groupBy("school_id")
        .agg(F.sum("searches").alias("search_execute_count"))
    )
    per_kind = ["school_view_count", "school_save_count", "event_view_count", "apply_click_count", "share_count"]
    zero = F.lit(0).cast("long")
    joined = (
        schools.select(F.col("id").alias("school_id"))
        .join(_per_school(counts), "school_id", "left")
        .join(searched, "school_id", "left")
    )
    search = F.coalesce("search_execute_count", zero)
    scored = joined.select(
        "school_id",
        (F.coalesce("raw", F.lit(0.0)) + search * F.lit(cfg.search_school_weight)).alias("raw"),
        (F.coalesce("n", zero) + search).alias("total_events"),
        *[F.coalesce(c, zero).alias(c) for c in per_kind],
        search.alias("search_execute_count"),
    )
    out = _over_max(scored, "raw", "popularity_score")
    return out.select("school_id", "popularity_score", "total_events", *per_kind, "search_execute_count")


def area_affinity(schools: DataFrame, links: DataFrame, counts: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """Affinity per area from ``log_counts``.

    A search counts once per area however many of its schools are linked to
    the station.  A search names one station, so that is the sum of searches
    over the distinct stations of the area: no distinct over log rows.
    """
    home = schools.select(F.col("id").alias("school_id"), "area")
    per_school = _per_school(counts).select("school_id", "raw", "n")
    behaved = home.join(per_school, "school_id", "left").groupBy("area").agg(
        F.coalesce(F.sum("raw"), F.lit(0.0)).alias("raw"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n")
    )
    area_stations = home.join(links.select("school_id", "station_id"), "school_id").select("area", "station_id").distinct()
    searched = (
        area_stations.join(_searches_per_station(counts), "station_id")
        .groupBy("area")
        .agg(F.sum("searches").alias("searches"))
    )
    search = F.coalesce("searches", F.lit(0).cast("long"))
    scored = behaved.join(searched, "area", "left").select(
        "area",
        (F.col("raw") + search * F.lit(cfg.search_area_weight)).alias("raw"),
        (F.col("n") + search).alias("event_count"),
        search.alias("search_execute_count"),
    )
    return _over_max(scored, "raw", "affinity_score").select("area", "affinity_score", "event_count", "search_execute_count")


def user_affinity(counts: DataFrame, user_ids: DataFrame | None = None) -> DataFrame:
    """Affinity per user and school from ``log_counts``, relative to the user's strongest school.

    The per-user maximum is a second aggregate joined back rather than a
    window: a very active account never has to be sorted in one task.
    """
    rows = _scored(counts)
    if user_ids is not None:
        rows = rows.join(user_ids.select("user_id").distinct(), "user_id", "left_semi")
    scored = rows.groupBy("user_id", "school_id").agg(F.sum(_weighed()).alias("raw"), F.sum("n").alias("event_count"))
    top = scored.groupBy("user_id").agg(F.max("raw").alias("top"))
    ratio = F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(F.lit(0.0))
    return scored.join(top, "user_id").select("user_id", "school_id", ratio.alias("affinity_score"), "event_count")


def prune(snapshot: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Drop snapshot rows whose school or area no longer exists."""
    return snapshot.join(dim.select(key).distinct(), key, "left_semi")


def refresh_snapshots(schools: DataFrame, links: DataFrame, log: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> dict[str, DataFrame]:
    """All three snapshots from one scan of the log, ready to be written."""
    counts = settle(log_counts(log))
    return {
        "popularity_snapshots": popularity(schools, links, counts, cfg),
        "area_affinity_snapshots": area_affinity(schools, links, counts, cfg),
        "user_affinity_snapshots": user_affinity(counts),
    }


def refresh_counts(snapshots: dict[str, DataFrame]) -> DataFrame:
    """Row count per refreshed snapshot."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("snapshot"), "rows") for name, df in sorted(snapshots.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
